"""Reports over the gold tables: facets, totals, coverage, histograms, states, run counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import truthy


def facet_counts(df: DataFrame, facets: Mapping[str, str]) -> DataFrame:
    """(facet, value, n) of every facet, name -> text or array column, by one shuffle; commonest first, then by value.

    Values are trimmed, blank ones left out; a row counts once for each value that it has.
    """
    types = dict(df.dtypes)

    def pairs(name: str, c: str) -> Column:
        values = F.col(c).cast("array<string>") if types[c].startswith("array") else F.array(F.col(c).cast("string"))
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("facet"), F.trim(v).alias("value")))

    lists = [pairs(name, c) for name, c in facets.items()]
    rows = df.select(F.explode(F.array_distinct(F.concat(*lists))).alias("f")).select("f.facet", "f.value").where("value <> ''")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n")).orderBy("facet", F.col("n").desc(), "value")


def top_values(df: DataFrame, column: str, k: int = 12) -> DataFrame:
    """The k commonest values of a text or array column, ties by value."""
    return facet_counts(df, {column: column}).select("value", "n").orderBy(F.col("n").desc(), "value").limit(k)


def era(year: Column) -> Column:
    """Decade of a year; before 1990 one era, missing or later than 2029 unknown."""
    return F.when(year.isNull() | (year == 0) | (year > 2029), "unknown").when(year < 1990, "pre-1990").otherwise(F.concat((year - year % 10).cast("string"), F.lit("s")))


def hero_stats(evidence: DataFrame) -> DataFrame:
    """(records, mentions, episodes, with_link, with_statements) of canonical records, in one row."""
    totals = evidence.agg(F.count("*").alias("records"), F.coalesce(F.sum("mention_count"), F.lit(0)).cast("long").alias("mentions"), F.count_if(truthy("pubmed_url")).alias("with_link"), F.count_if(F.coalesce("linked_pearl_count", F.lit(0)) > 0).alias("with_statements"))
    seen = evidence.select(F.explode("episodes").alias("e")).where(truthy("e.episode_url")).agg(F.count_distinct("e.episode_url").alias("episodes"))
    return totals.crossJoin(F.broadcast(seen)).select("records", "mentions", "episodes", "with_link", "with_statements")


def build_stats(evidence: DataFrame, k: int = 8) -> DataFrame:
    """(kind, value, n): totals of a build, its k commonest specialties, and all study types."""
    total = hero_stats(evidence)
    totals = total.select(F.explode(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in ("records", "mentions", "episodes")])).alias("t")).select("t.*")
    kinds = facet_counts(evidence.withColumn("study_type", F.coalesce(F.nullif("study_type", F.lit("")), F.lit("other"))), {"study type": "study_type"})
    return totals.unionByName(top_values(evidence, "specialty_tags", k).select(F.lit("specialty").alias("kind"), "value", "n")).unionByName(kinds.withColumnRenamed("facet", "kind"))


def coverage(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """(field, filled, total, percent): rows whose test holds, for each named test; percent to one digit, 0 of an empty table."""
    stats = df.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(test, F.lit(False))).alias(f"f{i}") for i, test in enumerate(fields.values())])
    rows = stats.select("total", F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"f{i}").alias("filled")) for i, name in enumerate(fields)])).alias("r"))
    return rows.select("r.field", "r.filled", "total", F.when(F.col("total") > 0, F.bround(F.lit(100.0) * F.col("r.filled") / F.col("total"), 1)).otherwise(0.0).alias("percent"))


def hundreds(df: DataFrame, number: str) -> DataFrame:
    """(bucket, n): rows by hundreds of a number; missing numbers are left out."""
    return df.where(F.col(number).isNotNull()).groupBy((F.floor(F.col(number) / 100) * 100).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def states(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, n): how often each state, confidence, grounding or reason occurs; null and blank read (none)."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("(none)")).alias("value")) for c in columns])).alias("s"))
    return rows.groupBy("s.field", "s.value").agg(F.count("*").alias("n"))


def run_counters(outcome: DataFrame, key: str) -> DataFrame:
    """(total, succeeded, failed, failed_keys) of a run's units; ``outcome``: (key, ok)."""
    bad = ~F.coalesce("ok", F.lit(False))
    return outcome.agg(F.count("*").alias("total"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"), F.array_sort(F.collect_list(F.when(bad, F.col(key)))).alias("failed_keys"))
