"""Review gates: approval, publication, adjudication, verification of quotes and links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import decision, let, truthy


def status_of(link: str, record: str) -> Column:
    """Link status, else the record's, else pending; empty text counts as absent."""
    return F.coalesce(F.nullif(F.col(link), F.lit("")), F.nullif(F.col(record), F.lit("")), F.lit("pending"))


def approved(status: str = "review_status", reviewer: str = "reviewed_by") -> Column:
    """Approved and attributed to a reviewer."""
    return F.coalesce(F.col(status) == "approved", F.lit(False)) & truthy(reviewer)


def publishable(record: str = "record_status", reviewer: str = "reviewed_by", link: str = "link_status", support: str = "support", confidence: str = "confidence", direct: str = "direct") -> Column:
    """Record approved, link not rejected, direct support, confidence anything but low (null passes)."""
    return approved(record, reviewer) & (status_of(link, record) != "rejected") & F.coalesce(F.col(support) == direct, F.lit(False)) & ~F.col(confidence).eqNullSafe("low")


def adjudicate(rows: DataFrame, selector: Column | None, verb: str, reviewer: str | None = None, status: str = "status", by: str = "reviewed_by") -> DataFrame:
    """Apply a reviewer's decision to the selected rows.

    Refuses to run without a selector, with an unknown verb, or to approve without a reviewer.
    """
    states = {"approve": "approved", "reject": "rejected", "reset": "pending"}
    if selector is None:
        raise ValueError("a decision needs a selector")
    if verb not in states:
        raise ValueError(f"unknown decision: {verb}")
    if verb == "approve" and not reviewer:
        raise ValueError("an approval needs a reviewer")
    hit = F.coalesce(selector, F.lit(False))
    who = F.lit(None).cast("string") if verb == "reset" else F.lit(reviewer)
    return rows.withColumn(status, F.when(hit, states[verb]).otherwise(F.col(status))).withColumn(by, F.when(hit, who).otherwise(F.col(by)))


def adjudicate_links(rows: DataFrame, links: str, selector, verb: str, at: str, note: str | None = None) -> DataFrame:
    """The same inside an array of link structs; the record's own status never moves."""
    state = {"approve": "approved", "reject": "rejected", "reset": "pending"}[verb]

    def decide(link: Column) -> Column:
        new = link.withField("review_status", F.lit(state)).withField("reviewed_at", F.lit(at)).withField("review_note", F.lit(note).cast("string"))
        return F.when(F.coalesce(selector(link), F.lit(False)), new).otherwise(link)

    return rows.withColumn(links, F.transform(links, decide))


def containment(docs: DataFrame, key: str, text: str, quotes: DataFrame, quote: str) -> DataFrame:
    """Pairs whose normalised text holds the normalised quote, as the columns of both; one plan at every size.

    A quote's inner words stand whole in any text that holds it. A run of three of them, one of
    a quote of three or four words, or three letters of a shorter quote is its seed: seeds meet the texts' own in an equi-join of
    narrow rows (key, seed), texts come back by ``key``, and ``contains`` settles the rest. Repeated rows
    stay repeated; a key may be null or shared. Null quotes are in no text, an empty one is in all.
    """
    n, m = fresh(docs, "_key"), fresh(quotes, "_quote")
    words, size = F.split(m, " "), F.size(F.split(m, " "))
    runs = F.transform(F.sequence(F.lit(2), size - 3), lambda i: F.slice(words, i, 3))
    # the longest run, as the likely rarest
    longest = F.array_join(F.array_max(F.transform(runs, lambda r: F.struct(F.length(F.array_join(r, " ")).alias("n"), r.alias("r"))))["r"], " ")
    seed = F.when(size >= 5, F.concat_ws(" ", F.lit("3"), longest)).when(size >= 3, F.concat(F.lit("1 "), F.element_at(words, 2))).otherwise(F.concat(F.lit("c "), F.substring(m, 1, 3)))
    asked = quotes.select(F.col(quote).alias(m)).where(F.col(m).isNotNull()).distinct().withColumn("_kind", F.when(size >= 5, 3).when(size >= 3, 1).otherwise(0)).withColumn("_seed", F.xxhash64(seed))

    def seeds(kind: int, items: Column) -> DataFrame:
        rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias(n), F.explode(F.array_distinct(items)).alias("_seed"))
        return rows.join(asked.where(F.col("_kind") == kind), "_seed").select(n, m)

    # bound once: an expression over the text inside a lambda would be made again for every word
    three = let(F.split(text, " "), lambda own: F.when(F.size(own) >= 3, F.transform(F.sequence(F.lit(1), F.size(own) - 2), lambda i: F.xxhash64(F.concat_ws(" ", F.lit("3"), own[i - 1], own[i], own[i + 1])))))
    one = F.transform(F.split(text, " "), lambda w: F.xxhash64(F.concat(F.lit("1 "), w)))
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    letters = F.flatten(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3)), lambda k: F.transform(places, lambda i: F.xxhash64(F.concat(F.lit("c "), F.substring(F.col(text), i, k))))))
    kinds = [r[0] for r in asked.select("_kind").distinct().collect()]  # three at most; each needs its own seeds of the texts
    parts = [seeds(kind, items) for kind, items in ((3, three), (1, one), (0, letters)) if kind in kinds]
    if not parts:
        return docs.join(quotes, F.contains(docs[text], quotes[quote])).limit(0)
    pairs = reduce(DataFrame.unionByName, parts).distinct()
    found = docs.join(pairs, docs[key].eqNullSafe(F.col(n))).where(F.contains(F.col(text), F.col(m))).drop(n)
    return found.join(quotes, F.col(m) == quotes[quote]).drop(m)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def verify_links(links: DataFrame, pool: DataFrame, on: Column, support: str, supports: Sequence[str], confidence: str, confidences: Sequence[str]) -> DataFrame:
    """Closed world: links into the pool with a known support; an unknown confidence becomes null."""
    kept = links.join(pool, on, "left_semi").where(F.col(support).isin(list(supports)))
    return kept.withColumn(confidence, F.when(F.col(confidence).isin(list(confidences)), F.col(confidence)))


def verb_state(v: Column | str) -> Column:
    return decision(v)
