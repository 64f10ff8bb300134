"""Aggregations with first-seen-wins ties; every one needs an input ordinal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.lineage import cut


def preferred_text(value: str, ord_: str = "ord") -> Column:
    """Longest non-empty text, the earliest of equally long ones."""
    v = F.col(value)
    return F.max_by(v, F.when(v.isNotNull() & (v != ""), F.struct(F.length(v), -F.col(ord_))))


def first_present(value: Column, ord_: str = "ord") -> Column:
    """Earliest value that isn't null."""
    return F.min_by(value, F.when(value.isNotNull(), F.col(ord_)))


def sorted_set(value: Column) -> Column:
    return F.array_sort(F.collect_set(value))


def first_seen_modes(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ord_: str = "ord") -> DataFrame:
    """Most frequent non-empty value of each column by key, the earliest on ties; one shuffle for all columns.

    The columns are stacked as (key, field, text), counted with map-side partial
    aggregation, and pivoted back; values come back in their own types.
    """
    stacked = df.select(*keys, ord_, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_s"))
    counted = stacked.select(*keys, ord_, "_s.field", "_s.value").where("value is not null and value <> ''").groupBy(*keys, "field", "value").agg(F.count("*").alias("_n"), F.min(ord_).alias("_o"))
    best = lambda c: F.max_by("value", F.when(F.col("field") == c, F.struct("_n", -F.col("_o")))).cast(df.schema[c].dataType).alias(c)
    return counted.groupBy(*keys).agg(*[best(c) for c in columns])


def merge_records(df: DataFrame, key: str, texts: Sequence[str], modes: Sequence[str], ord_: str = "ord") -> DataFrame:
    """One record per key: longest texts, first-seen modes, first ordinal, number of rows."""
    merged = df.groupBy(key).agg(*[preferred_text(c, ord_).alias(c) for c in texts], F.min(ord_).alias("first_ord"), F.count("*").alias("mentions"))
    return merged.join(first_seen_modes(df, [key], modes, ord_), key, "left")


def rollup(df: DataFrame, key: str, group: str, fields: Sequence[str], ord_: str = "ord") -> DataFrame:
    """(key, group, first present value of each field, first ordinal): two-level roll-up, inner level."""
    return df.where(F.col(group).isNotNull()).groupBy(key, group).agg(*[first_present(F.col(c), ord_).alias(c) for c in fields], F.min(ord_).alias("first_ord"))


def dense_ids(df: DataFrame, order: Sequence[Column], name: str = "id") -> DataFrame:
    """0, 1, 2 ... in a total order, without gathering the rows in one partition.

    Rows are range-partitioned by the order; a partition's first number is the
    sum of the counts before it. The counts are one row per partition. The
    ranges are written before they are counted: two readings of an unwritten
    plan could sample different bounds.
    """
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", row))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranged.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def votes(df: DataFrame, key: str, label: str, weight: str, ord_: str = "ord") -> DataFrame:
    """(key, label, score, is_top, is_secondary): weighted votes; first-seen label wins ties, half of the top score is secondary."""
    scores = df.groupBy(key, label).agg(F.sum(weight).alias("score"), F.min(ord_).alias("_o"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "_o", label)
    ranked = scores.withColumn("_r", F.row_number().over(w)).withColumn("_top", F.max("score").over(Window.partitionBy(key)))
    return ranked.select(key, label, "score", (F.col("_r") == 1).alias("is_top"), ((F.col("_r") > 1) & (F.col("score") * 2 >= F.col("_top"))).alias("is_secondary"))
