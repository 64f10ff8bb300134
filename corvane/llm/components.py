"""Distributed union-find: connected components by alternating large and small stars.

Every round is two shuffles over the edges, written to the shared folder, so a
lost executor costs at most the current round. Rounds grow with the logarithm
of the graph; the least neighbour of a node is a window that spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Stored


def _least(edges: DataFrame) -> DataFrame:
    """Every edge with the least neighbour of its first end, by one shuffle."""
    return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> Stored:
    """(node, root) of every node that has an edge to another one; root is the component's least node.

    Loops and null ends are left out, repeated edges count once. An empty table
    gives an empty one. Caller drops the returned table when it is used up.
    """
    u, v = F.col(a), F.col(b)
    start = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    table, seen = Stored(start, "edges"), None
    while True:
        # large star: neighbours above a node move to the least of its neighbourhood
        both = table.df.unionByName(table.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: a node and its lower neighbours move to the least of them
        moved = _least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = Stored(moved.select("e.u", "e.v").where("u != v").distinct(), "edges")
        table.drop()
        table = new
        now = table.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    table.df = table.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = table.df.select(F.col("root").alias("node"), "root").distinct()
    table.df = table.df.unionByName(roots)
    return table
