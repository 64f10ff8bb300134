"""Scalar text functions as native Column expressions.

Null behaviour: a null input gives null unless a function says otherwise; falsy
values (null, empty text, 0, empty array) count as absent where ``truthy`` is used.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import vocab

_BLANK = "(?U)\\s+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with x evaluated once: keeps expressions that use a value many times small."""
    return F.element_at(F.transform(F.array(x), body), 1)


def squeeze(v: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(v).cast("string"), _BLANK, " "))


def clean_text(v: Column | str) -> Column:
    """Squeezed text; empty text and written nulls ("n/a", "none", ...) become null."""
    return let(squeeze(v), lambda x: F.when((x != "") & ~F.lower(x).isin(vocab.SENTINELS), x))


def key_text(v: Column | str) -> Column:
    """Lower-case ASCII letters and digits in single spaces; null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(clean_text(v)), "[^a-z0-9]+", " ")), F.lit(""))


def nullify(v: Column | str) -> Column:
    """Empty text to null."""
    return F.nullif(_c(v), F.lit(""))


def truthy(v: Column | str, kind: str = "string") -> Column:
    """Whether a value counts as present: not null, '', 0, false or an empty array."""
    x = _c(v)
    test = {"string": x != "", "number": x != 0, "array": F.size(x) > 0, "boolean": x}[kind]
    return F.coalesce(x.isNotNull() & test, F.lit(False))


def study_type(v: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.STUDY_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key_text(v)), F.lit("other"))


def tag_list(v: Column | str, allowed: list[str] | None = None) -> Column:
    """Sorted distinct tags of the vocabulary, from text split at commas, semicolons and slashes."""
    parts = F.transform(F.split(F.coalesce(_c(v), F.lit("")), "[,;/]"), lambda x: F.lower(clean_text(x)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isin(allowed or vocab.SPECIALTIES))))


def year(v: Column | str) -> Column:
    """First year of 1900-2099 that stands by itself in a text."""
    return F.regexp_extract(_c(v).cast("string"), r"(?U)\b((?:20|19)[0-9]{2})\b", 1).try_cast("int")


def registry_id(v: Column | str) -> Column:
    return F.upper(nullify(F.regexp_extract(clean_text(v), r"(?i)NCT\d{8}", 0)))


def sample_size(v: Column | str) -> Column:
    """A positive integer as it is; of a text the first number, thousands separators removed; else null."""
    whole = F.when(F.typeof(_c(v)).isin("tinyint", "smallint", "int", "bigint"), _c(v).cast("string").try_cast("long"))
    n = F.regexp_replace(F.regexp_extract(_c(v).cast("string"), r"\d[\d,]*", 0), ",", "").try_cast("long")
    n = F.when(F.typeof(_c(v)) == "boolean", F.lit(None)).otherwise(F.coalesce(whole, n))
    return F.when(n > 0, n)


def largest_sample(v: Column | str) -> Column:
    """Largest positive ``n = 1,234`` of a text."""
    found = F.regexp_extract_all(F.coalesce(_c(v), F.lit("")), F.lit(r"(?i)\bn\s*=\s*([0-9,]{1,9})\b"), 1)
    return F.array_max(F.filter(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("long")), lambda n: n > 0))


def journal(text: Column | str, url: Column | str) -> Column:
    """Publisher domain in the URL first, then the first matching name in the text."""
    rules = [F.when(F.contains(_c(url), F.lit(d)), name) for d, name in vocab.PUBLISHER_RULES]
    rules += [F.when(_c(text).rlike(f"(?i){r}"), name) for r, name in vocab.JOURNAL_RULES]
    return F.coalesce(*rules)


def match_tokens(v: Column | str) -> Column:
    """Distinct words of 4 letters or more that aren't stop words."""
    return F.array_distinct(F.filter(F.split(key_text(v), " "), lambda t: (F.length(t) >= 4) & ~t.isin(vocab.MATCH_STOP_WORDS)))


def content_tokens(v: Column | str) -> Column:
    """As ``match_tokens``, without one trailing s of words longer than 4 letters."""
    words = F.filter(F.split(key_text(v), " "), lambda t: (F.length(t) >= 4) & ~t.isin(vocab.MATCH_STOP_WORDS))
    return F.array_distinct(F.transform(words, lambda t: F.when((F.length(t) > 4) & t.endswith("s"), F.regexp_replace(t, "s$", "")).otherwise(t)))


def statement_key(v: Column | str) -> Column:
    """Key text without a trailing citation in parentheses that ends in a year."""
    return key_text(F.regexp_replace(clean_text(v), r"\s*[(][^()]*\b(?:20|19)[0-9]{2}[a-z]?[.]?[)]\s*$", ""))


def ends_sentence(v: Column | str) -> Column:
    return F.coalesce(F.rtrim(_c(v)).rlike("[.!?]$"), F.lit(False))


def topic_label(v: Column | str) -> Column:
    """Topic without decoration at its ends; generic labels and a person's name in the possessive become null."""
    x = F.regexp_replace(clean_text(v), r"^[ ,&/-]+|[ ,&/-]+$", "")
    person = x.rlike("(?i)^[a-z][a-z .]*['’]s$")
    return F.when((x == "") | F.lower(x).isin(vocab.GENERIC_TOPICS) | person, None).otherwise(x)


def strip_heading(v: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(v), "[:\\-–—]+\\s*$", ""))


def tidy_transcript(v: Column | str) -> Column:
    """Unix line ends, no blanks at line ends, at most one empty line."""
    x = F.regexp_replace(F.regexp_replace(_c(v), "\r\n?", "\n"), "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def looks_generated(v: Column | str) -> Column:
    return F.coalesce(F.substring(_c(v), 1, 800).rlike(r"(?i)\b(ai[- ]generated|automatically generated|auto[- ]generated|machine transcri)"), F.lit(False))


def quote_text(v: Column | str) -> Column:
    return F.lower(squeeze(v))


def quotes_verbatim(text: Column | str, quote: Column | str, least: int = 15) -> Column:
    """Whether a quote of ``least`` letters or more is in the text, but for case and white space."""
    return F.coalesce((F.length(F.trim(_c(quote))) >= least) & F.contains(quote_text(text), quote_text(quote)), F.lit(False))


def number_in_title(title: Column | str, url: Column | str) -> Column:
    """``#123`` in the title, else a delimited number of up to 4 digits in title or URL."""
    mark = F.regexp_extract(_c(title), r"#([0-9]{1,4})\b", 1)
    loose = [F.regexp_extract(_c(x), r"(?:^|[^0-9A-Za-z])(\d{1,4})(?:$|[^0-9A-Za-z])", 1) for x in (title, url)]
    return F.coalesce(*[nullify(x) for x in (mark, *loose)]).cast("int")


def numbers_in_title(title: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(_c(title), F.lit("")), F.lit(r"#([0-9]{1,4})\b"), 1), lambda x: x.cast("int")))


def slug(v: Column | str) -> Column:
    """Title as a path segment: prefix up to ``#n:`` dropped, accents folded, & spelt out."""
    x = F.regexp_replace(F.regexp_replace(fold_accents(_c(v)), "[^\\x{00}-\\x{7F}’]", ""), r"^.*?#\d+\s*:?\s*", "")
    x = F.regexp_replace(F.regexp_replace(F.lower(x), "&", " and "), "['’]", "")
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Letters that decompose to one ASCII letter or digit, those with what they become, marks to drop; letters that become several."""
    one, many, marks = {}, {}, []
    for c in map(chr, range(0x80, 0x30000)):
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and plain.isascii() and plain.isalnum() and ord(c) < 0x10000:
            (one if len(plain) == 1 else many)[c] = plain
    return "".join(one) + "".join(m for m in marks if ord(m) < 0x10000), "".join(one.values()), many


_FROM, _TO, _SEVERAL = _fold_table()
#: Where letters that become several lie: a few ranges are quick to test, a class of hundreds of letters isn't.
_MAY = "[\u0132\u0133\u0149\u01c4-\u01cc\u01f1-\u01f3\u20a8\u2100-\u33ff\ua700-\ua7ff\ufb00-\uffff]"


def fold_accents(v: Column | str) -> Column:
    """Letters without their marks, compatibility forms as plain letters (ő, ﬁ, Š, Ⅳ); other characters stay."""

    def several(x: Column) -> Column:
        # one letter at a time, and only in texts that have such letters at all
        table = F.create_map(*[F.lit(y) for kv in _SEVERAL.items() for y in kv])
        spelt = F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c.rlike(_MAY), F.coalesce(F.try_element_at(table, c), c)).otherwise(c)), "")
        return F.when(x.rlike(_MAY), spelt).otherwise(x)

    return F.translate(let(_c(v), several), _FROM, _TO)


def search_text(v: Column | str) -> Column:
    """Text as the search sees it: no accents, lower case, letters and digits only."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(fold_accents(_c(v))), "[^a-z0-9]+", " ")), F.lit(""))


def vague_label(v: Column | str) -> Column:
    """Labels that name nothing: bare numbers, or a kind of study with no name."""
    kinds = "cohort|observational|prospective|randomized|recent|retrospective"
    nouns = "analysis|guidance|guideline|report|review|study|trial"
    named = f"(?i)(?:(?:the|a) )?[0-9]{{0,4}}\\s*(?:(?:{kinds}) )*(?:{nouns})s?[.]?"
    label = F.trim(_c(v))
    return F.coalesce((label != "") & label.rlike(f"^(?:[0-9,\\s]+|{named})$"), F.lit(False))


def truncated(v: Column | str, most: int) -> Column:
    """Trimmed, cut to ``most`` letters; empty becomes null."""
    return nullify(F.substring(F.trim(_c(v)), 1, most))


def salted_hash(value: Column | str, salt: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), _c(value)), 256)


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the row's values as compact JSON, keys in order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def progress(done: Column | str, total: Column | str, width: int = 20) -> Column:
    filled = F.when(_c(total) > 0, F.floor(_c(done) * width / _c(total))).otherwise(0).cast("int")
    bar = F.rpad(F.repeat(F.lit("#"), filled), width, "-")
    percent = F.when(_c(total) > 0, F.floor(_c(done) * 100 / _c(total))).otherwise(0).cast("int")
    return F.format_string("[%s] %d/%d (%d%%)", bar, _c(done), _c(total), percent)


def decision(v: Column | str) -> Column:
    """Verbs of a reviewer to a state; unknown ones become null."""
    table = {verb: state for state, verbs in (("approved", "accept approve approved"), ("rejected", "deny reject rejected"), ("reset", "pending reset")) for verb in verbs.split()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(F.trim(_c(v))))
