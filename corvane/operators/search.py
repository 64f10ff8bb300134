"""Search over canonical records: query parsing, lexical scores, facets, sorting, paging.

A query is tiny and is parsed on the driver; scoring is one projection over the
records, so filters and needed columns reach the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import let, search_text

STOP = frozenset("with vs to the or on of is in how from for by at as are and an a".split())

#: words that search as each other
SYNONYMS = {
    short: long.split("|")
    for short, long in (
        line.strip().split(": ")
        for line in """
        t2dm: type 2 diabetes|diabetes
        sglt2: sglt-2|sodium glucose|gliflozin|canagliflozin|dapagliflozin|empagliflozin
        sglt 2: sglt2|sodium glucose|gliflozin|canagliflozin|dapagliflozin|empagliflozin
        mi: myocardial infarction
        htn: blood pressure|hypertension
        hf: heart failure
        glp1: semaglutide|glp-1
        glp 1: semaglutide|glp-1
        doac: anticoagulation|direct oral anticoagulant
        ckd: kidney|chronic kidney disease
        bp: hypertension|blood pressure
        afib: atrial fibrillation
        """.strip().splitlines()
    )
}


@dataclass(frozen=True)
class Parsed:
    words: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


def fold(v: str) -> str:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
    return " ".join(re.findall("[a-z0-9]+", plain.lower()))


def parse(query: str) -> Parsed:
    """``word "a phrase" -excluded``; stop words count only inside quotes."""
    words: list[str] = []
    phrases: list[str] = []
    excluded: list[str] = []
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query or ""):
        if plain.startswith("-"):
            minus, plain = "-", plain[1:]
        term = fold(quoted or plain)
        if not term:
            continue
        if minus:
            excluded.append(term)
        elif quoted:
            phrases.append(term)
        elif term not in STOP:
            words.append(term)
    return Parsed(*(tuple(dict.fromkeys(x)) for x in (words, phrases, excluded)))


def variants(term: str) -> list[str]:
    """A word and its synonyms."""
    return list(dict.fromkeys(fold(x) for x in [term, *SYNONYMS.get(term, [])]))


def has_term(text: Column, term: str) -> Column:
    """Terms of up to 3 letters match whole words only, longer ones anywhere."""
    if len(term) <= 3 and " " not in term:
        return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {term} "))
    return F.contains(text, F.lit(term))


@dataclass(frozen=True)
class Field:
    name: str
    word: int
    phrase: int


FIELDS = (Field("title", 34, 72), Field("topic", 25, 52), Field("summary", 15, 34), Field("statements", 14, 30), Field("metadata", 12, 24), Field("episode", 8, 18), Field("citations", 8, 18))


def _field_score(term: str, fields: tuple[Field, ...], phrase: bool, of: dict[str, Column]) -> Column:
    """Sum of the weights of the fields that hold the term, a third more near a field's start."""
    total: Column = F.lit(0)
    for f in fields:
        w = f.phrase if phrase else f.word
        near = F.locate(term, of[f.name]).between(1, 26)
        total = total + F.when(has_term(of[f.name], term), F.lit(w) + F.when(near, int(0.35 * w + 0.5)).otherwise(0)).otherwise(0)
    return total


def lexical(df: DataFrame, query: str | Parsed, fields: tuple[Field, ...] = FIELDS, bonus: Column | None = None) -> DataFrame:
    """Rows that match, with ``score`` and ``coverage``.

    Phrases must all be there; excluded terms, in any variant, must not. Of words, all
    must match up to two of them, two thirds beyond. ``bonus`` adds to the score.
    """
    q = parse(query) if isinstance(query, str) else query
    fields = tuple(f for f in fields if f.name in df.columns)
    folded = df.withColumn("_f", F.struct(*[search_text(f.name).alias(f.name) for f in fields]))
    of = {f.name: F.col(f"_f.{f.name}") for f in fields}
    anywhere = lambda term: reduce(lambda a, b: a | b, [has_term(c, term) for c in of.values()])
    keep: Column = F.lit(True)
    for term in q.excluded:
        for v in variants(term):
            keep = keep & ~anywhere(v)
    for term in q.phrases:
        keep = keep & anywhere(term)
    score: Column = F.lit(0.0)
    for term in q.phrases:
        score = score + _field_score(term, fields, True, of) + 38
    hits: Column = F.lit(0)
    for term in q.words:
        best = F.greatest(*[_field_score(v, fields, False, of) for v in variants(term)], F.lit(0))
        hits = hits + (best > 0).cast("int")
        score = score + best
    n = len(q.words)
    cover = hits / n if n else F.lit(1.0)
    need = 1.0 if n <= 2 else 0.67
    out = folded.where(keep).withColumn("coverage", cover.cast("double")).where(F.col("coverage") >= need)
    return out.withColumn("score", (score + F.col("coverage") * 22 + (bonus if bonus is not None else F.lit(0.0))).cast("double")).drop("_f")


def fuzzy_blend(text: Column, query: str, lexical_score: Column) -> Column:
    """Edit-distance share blended with the lexical score; not the scoring of any client library."""
    q = fold(query)
    s = let(search_text(text), lambda t: F.levenshtein(t, F.lit(q)) / F.greatest(F.length(t), F.lit(len(q)), F.lit(1)))
    blend = F.lit(18.0) + (F.lit(1.0) - s) * 42
    return F.when(lexical_score > 0, lexical_score + blend * 0.35).otherwise(F.when(s <= 0.42, blend))


SORTS = {
    "relevance": [("score", False), ("coverage", False), ("episode_count", False), ("year", False), ("title", True)],
    "episode_desc": [("latest", False), ("title", True)], "episode_asc": [("latest", True), ("title", True)],
    "mentions": [("mention_count", False), ("title", True)], "episodes": [("episode_count", False), ("title", True)],
    "year_desc": [("year", False), ("title", True)], "year_asc": [("year", True), ("title", True)], "title": [("title", True)],
}


def sort_order(df: DataFrame, name: str, *ties: str) -> list[Column]:
    """Sort keys of a named order, as far as the table has them, and unique ties behind."""
    keys = [(c, up) for c, up in SORTS.get(name, SORTS["relevance"]) if c in df.columns]
    cols = [F.coalesce(F.col(c), F.lit(0)) if dict(df.dtypes)[c] != "string" else F.col(c) for c, _ in keys]
    return [c.asc() if up else c.desc() for c, (_, up) in zip(cols, keys)] + [F.col(t).asc() for t in ties]


@dataclass(frozen=True)
class QuerySpec:
    """State of a search page; ``to_params`` and ``from_params`` are inverse."""

    q: str = ""
    topic: str = ""
    era: str = ""
    link: str = ""
    sort: str = ""
    specialties: tuple[str, ...] = field(default=())
    types: tuple[str, ...] = field(default=())
    page: int = 1

    def to_params(self) -> str:
        pairs = [(k, v) for k, v in (("q", self.q), ("topic", self.topic), ("era", self.era), ("link", self.link), ("sort", self.sort)) if v]
        pairs += [("specialty", x) for x in self.specialties] + [("type", x) for x in self.types]
        return urlencode(pairs + ([("page", self.page)] if self.page > 1 else []))

    @classmethod
    def from_params(cls, params: str) -> QuerySpec:
        p = parse_qs(params.lstrip("?"))
        one = lambda k: (p.get(k) or [""])[0]
        number = one("page")
        return cls(one("q"), one("topic"), one("era"), one("link"), one("sort"), tuple(p.get("specialty", [])), tuple(p.get("type", [])), max(1, int(number)) if number.isdigit() else 1)

    def toggled(self, facet: str, value: str) -> QuerySpec:
        now = getattr(self, facet)
        return replace(self, **{facet: tuple(x for x in now if x != value) if value in now else (*now, value)}, page=1)

    def effective_sort(self) -> str:
        return self.sort or ("relevance" if self.q else "episode_desc")


def facets(df: DataFrame, spec: QuerySpec, specialties: str = "specialties", kind: str = "study_type", era_col: str = "era", url: str = "url", topic: tuple[str, ...] = ()) -> DataFrame:
    """Facet filters: any value within a facet, all facets together."""
    if spec.specialties:
        df = df.where(F.arrays_overlap(specialties, F.array(*[F.lit(x) for x in spec.specialties])))
    if spec.types:
        df = df.where(F.col(kind).isin(list(spec.types)))
    if spec.era:
        df = df.where(F.col(era_col) == spec.era)
    if spec.link:
        has = F.coalesce(F.col(url) != "", F.lit(False))
        df = df.where(has if spec.link == "with" else ~has)
    if spec.topic and topic:
        df = df.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(spec.topic.lower())), F.lit(False)) for c in topic]))
    return df
