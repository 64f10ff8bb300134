"""Joins: domain suffixes, alias cascades, merges, upserts, gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffix_match(left: DataFrame, right: DataFrame, host: str, base: str) -> DataFrame:
    """Rows whose host is a base domain or below one: dotted suffixes explode, then an equi-join."""
    parts = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return left.withColumn("_suffix", F.explode(suffixes)).join(right, F.col("_suffix") == F.col(base)).drop("_suffix")


def alias_cascade(records: DataFrame, key: str, aliases: Sequence[Column], table: DataFrame, alias: str, target: str) -> DataFrame:
    """(key, target, level): the first alias of each record that the alias table knows; null if none.

    Of several targets of one alias the table's first (least ``ord``) counts.
    """
    tried = records.select(key, F.posexplode(F.array(*aliases)).alias("level", "_alias")).where("_alias is not null")
    one = table.groupBy(alias).agg(F.min_by(target, "ord").alias(target))
    hits = tried.join(one, F.col("_alias") == F.col(alias)).groupBy(key).agg(F.min(F.struct("level", target)).alias("_hit"))
    return records.select(key).join(hits, key, "left").select(key, F.col(f"_hit.{target}").alias(target), F.col("_hit.level").alias("level"))


def once(df: DataFrame, inputs: Sequence[str], derived: Mapping[str, Column]) -> DataFrame:
    """The table with derived columns that are computed once for each distinct combination of their inputs."""
    table = df.select(*inputs).distinct().select(*[F.col(c).alias(f"_in_{c}") for c in inputs], *[v.alias(f"_out_{c}") for c, v in derived.items()])
    meets = [F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in inputs]
    joined = df.join(table, reduce(Column.__and__, meets))
    kept = [F.col(c) for c in df.columns if c not in derived]
    return joined.select(*kept, *[F.col(f"_out_{c}").alias(c) for c in derived])


def together(df: DataFrame, key: str) -> DataFrame:
    """The table with the rows of a key in one partition, written to one shuffle that all its readers share.

    Columns travel as one value, else each reader would prune its own and compute the table anew.
    """
    packed = df.where(F.col(key).isNotNull()).select(F.col(key), F.array(F.struct(*[c for c in df.columns if c != key])).alias("_row")).repartition(key)
    return packed.select(key, *[F.col("_row")[0][c].alias(c) for c in df.columns if c != key])


def attach_or_append(base: DataFrame, extra: DataFrame, key: str, attach: Sequence[str]) -> DataFrame:
    """Base rows with the matching extra columns, and extra rows without a match as new ones (an upsert)."""
    matched = base.join(extra.select(key, *attach), key, "left")
    fresh = extra.join(base.select(key), key, "left_anti")
    return matched.unionByName(fresh, allowMissingColumns=True)


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """New rows take the place of all old rows of their groups; other groups stay."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new keys are added, known keys keep their old row."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def gap(universe: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return universe.join(done.select(key), key, "left_anti")


def restrict(pool: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return pool.join(allowed.select(key), key, "left_semi")


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def in_range(points: DataFrame, ranges: DataFrame, group: str, at: str, start: str, end: str, keep: Sequence[str]) -> DataFrame:
    """Each point with the first range of its group that holds it (``start <= at < end``), null columns if none. Equal points stay apart."""
    points = points.withColumn("_id", F.monotonically_increasing_id())
    right = ranges.select(F.col(group).alias("_g"), F.col(start).alias("_s"), F.col(end).alias("_e"), *keep)
    cond = (points[group] == right["_g"]) & (points[at] >= right["_s"]) & (points[at] < right["_e"])
    hit = points.join(right, cond, "left")
    w = Window.partitionBy("_id").orderBy("_s")
    return hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*[c for c in points.columns if c != "_id"], *keep)
