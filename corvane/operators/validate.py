"""Integrity rules: each is one aggregate, a report is their union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rule(counted: DataFrame, name: str) -> DataFrame:
    return counted.select(F.lit(name).alias("rule"), F.col("n").cast("long").alias("violations"))


def violates(df: DataFrame, bad: Column, name: str) -> DataFrame:
    return _rule(df.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("n")), name)


def unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows beyond the first of each key, by a partial aggregation on the key."""
    return _rule(df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")), name)


def known(df: DataFrame, key: str, other: DataFrame, other_key: str, name: str) -> DataFrame:
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"))
    return _rule(keys.join(other.select(F.col(other_key).alias("_k")), "_k", "left_anti").agg(F.count("*").alias("n")), name)


def known_items(df: DataFrame, items: str, other: DataFrame, other_key: str, name: str) -> DataFrame:
    return known(df.select(F.explode(items).alias("_i")), "_i", other, other_key, name)


def allowed(df: DataFrame, column: str, values: Sequence[str], name: str) -> DataFrame:
    return violates(df, ~F.col(column).isin(list(values)), name)


def present(df: DataFrame, column: str, name: str) -> DataFrame:
    return violates(df, F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == "", name)


def any_present(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return violates(df, F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns]).isNull(), name)


def attributed(df: DataFrame, status: str, by: str, name: str) -> DataFrame:
    return violates(df, (F.col(status) == "approved") & (F.coalesce(F.col(by), F.lit("")) == ""), name)


def not_truncated(df: DataFrame, column: str, name: str) -> DataFrame:
    return violates(df, F.col(column).rlike(r"(?i)(?:[\(\[]|\b(?:a|an|and|as|at|by|for|from|in|of|on|or|the|to|with))\s*$"), name)


def collisions(df: DataFrame, key: str, title: str, least: int, name: str) -> DataFrame:
    return _rule(df.groupBy(key).agg(F.count_distinct(title).alias("t")).agg(F.count_if(F.col("t") >= least).alias("n")), name)


def matches(df: DataFrame, column: str, regex: str, name: str) -> DataFrame:
    return violates(df, F.col(column).isNotNull() & ~F.col(column).rlike(regex), name)


def report(rules: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def assert_clean(rules: DataFrame) -> None:
    bad = [(r.rule, r.violations) for r in rules.where("violations > 0").collect()]
    if bad:
        raise ValueError("; ".join(f"{rule}: {n}" for rule, n in bad))
