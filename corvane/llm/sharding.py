"""Operator 4, sharding: contiguous shards of equal bytes from global prefix sums.

Only (id, hash of the text, bytes) is range-partitioned by id. Each partition's
byte total goes to the driver (one number per partition), where the totals'
prefix sum gives every partition its global offset; a running sum within the
partition does the rest. A row belongs to the shard in which its first byte
falls when the total is cut at equal targets, so a shard is off its target by
less than one document. No text is shuffled: ``shard_documents`` compares each
row with the first key of every shard.

Defined results: null texts have 0 bytes. The order is by id, null ids first,
rows of one id by a hash of their text. Rows equal in id and text stay
together, in the shard of the first of them. An empty table has no shards;
with more shards than documents some shards stay empty. Columns of the table
named like a computed one are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Stored, fresh, text_bytes


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, byte_start, shard_id), one row for each row of the table."""
    return _plan(docs, n_shards, id_col, text_col).drop("tie")


def _plan(docs: DataFrame, n_shards: int, id_col: str, text_col: str) -> DataFrame:
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.col(text_col)
    narrow = Stored(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tie"), text_bytes(text).alias("n_bytes")), "sizes")
    key = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    # stored, as partition numbers must be the same in both readings below
    parts = Stored(narrow.df.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "ranges")
    narrow.drop()
    offsets, total = [], 0
    for row in parts.df.groupBy("part").agg(F.sum("n_bytes").alias("n")).orderBy("part").collect():
        offsets.append((row.part, total))
        total += row.n
    starts = docs.sparkSession.createDataFrame(offsets, "part int, offset long")  # one row per partition
    running = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("part", "doc_id", "tie")
    return (
        parts.df.withColumn("byte_start", F.sum("n_bytes").over(running) - F.col("n_bytes"))
        .withColumn("group_start", F.min("byte_start").over(group))
        .join(F.broadcast(starts), "part")
        .withColumn("byte_start", F.col("byte_start") + F.col("offset"))
        .withColumn("cut", F.expr(f"cast(group_start + offset as decimal(38, 0)) * {int(n_shards)} div cast({max(total, 1)} as decimal(38, 0))"))
        .select("doc_id", "tie", "n_bytes", "byte_start", F.least("cut", F.lit(n_shards - 1)).cast("int").alias("shard_id"))
    )


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", name: str = "shard_id") -> DataFrame:
    """All columns of the table and the shard of each row; map-only over the texts.

    The first keys of the shards travel as one broadcast row, in groups of about the square root of
    their number: a row is compared with the groups' first keys and then with those of one group.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    plan = _plan(docs, n_shards, id_col, text_col)
    # at most one row per shard: the first key of each
    first = plan.groupBy("shard_id").agg(F.min(F.struct("doc_id", "tie")).alias("k")).select("k.doc_id", "k.tie", "shard_id").orderBy("shard_id")
    bounds = Stored(first, "bounds")
    rows = bounds.df.orderBy("shard_id").collect()
    bounds.drop()
    if not rows:
        return docs.select(*kept, F.lit(None).cast("int").alias(name))
    width = max(1, round(len(rows) ** 0.5))
    groups = [[tuple(r) for r in rows[i : i + width]] for i in range(0, len(rows), width)]
    bound = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("tie", T.LongType()), T.StructField("shard_id", T.IntegerType())])
    table, key = fresh(docs, "shard_bounds"), fresh(docs, "shard_key")
    one = docs.sparkSession.createDataFrame([(groups,)], T.StructType([T.StructField(table, T.ArrayType(T.ArrayType(bound)))]))
    here = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"))
    reached = lambda b: F.struct(b["doc_id"].alias("doc_id"), b["tie"].alias("tie")) <= F.col(key)
    group = F.element_at(table, F.size(F.filter(table, lambda g: reached(F.element_at(g, 1)))))
    shard = let(group, lambda g: F.element_at(g, F.size(F.filter(g, reached)))["shard_id"])
    return docs.crossJoin(F.broadcast(one)).withColumn(key, here).select(*kept, shard.cast("int").alias(name))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with x evaluated once."""
    return F.element_at(F.transform(F.array(x), body), 1)


#: DuckDB: {docs} a relation, {columns} what to keep of it, {n} the shards.
ORACLE = """
    with d as (select *, coalesce(strlen(text), 0)::bigint as n_bytes from {docs}),
    s as (select *, (sum(n_bytes) over (order by doc_id nulls first, text nulls first rows between unbounded preceding and current row) - n_bytes)::bigint as byte_start,
        (sum(n_bytes) over ())::bigint as total from d),
    g as (select *, min(byte_start) over (partition by doc_id, text) as group_start from s)
    select {columns}, least(group_start::hugeint * {n} // greatest(total, 1), {n} - 1)::int as shard_id from g
"""
