"""Exact verification of candidate pairs, shared by the joins on documents and on lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernel as k
from corvane.llm.common import Stored


def verified_pairs(pairs: DataFrame, attach: Callable, sizes: DataFrame, sets_of: Callable, threshold: float, tile: int = 512, tile_size: int = 2_000_000, dtype: type = np.uint64, connect: bool = False) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b) whose sets reach the threshold.

    ``attach(lists)``: the rows (d, keys) of ``lists`` with the text of d, as (id, text, keys); several texts
    of one id all count. ``sizes``: (id, size), elements of each set, about. ``sets_of(column)``: (row, element
    of ``dtype``) of a column's sets, in order of rows.
    ``connect``: only what connects the same sets is wanted; a block's own union-find skips
    pairs that pairs before them connect, and leaves a spanning forest of its part of the graph.
    Every set goes once to each block that its pairs are in, cut in tiles of ``tile`` sets and ``tile_size`` elements.
    """
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
    of = lambda x: label.select(F.col("a").alias(x), F.col("label").alias(f"l{x}"))
    blocks = Stored(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.least("la", "lb").alias("block")), "blocks")
    held = blocks.df.select("block", F.col("a").alias("id")).unionByName(blocks.df.select("block", F.col("b").alias("id"))).distinct()
    tiles = held.join(sizes, "id").groupBy("block").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") / tile_size)).alias("tiles"))
    cut = lambda d: F.pmod(F.xxhash64(d), F.col("tiles"))
    tiled = blocks.df.join(tiles, "block").withColumn("ta", cut("a")).withColumn("tb", cut("b"))
    keyed = Stored(tiled.select(F.xxhash64("block", F.least("ta", "tb"), F.greatest("ta", "tb")).alias("key"), "a", "b"), "keyed")
    blocks.drop()
    need = keyed.df.select("key", F.col("a").alias("d")).unionByName(keyed.df.select("key", F.col("b").alias("d"))).distinct()
    found = attach(need.groupBy("d").agg(F.collect_list("key").alias("keys"))).select("id", "text", "keys")

    # texts travel and sets are made where they are compared: n-gram hashes are larger than texts
    sets = found.select(F.explode("keys").alias("key"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = sets.unionByName(keyed.df.select("key", "a", "b", F.lit(None).cast("string").alias("text")))
    # within a key the sets come first (their b is null), then the pairs
    rows = rows.repartition("key").sortWithinPartitions("key", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, parent = None, {}, {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for part in k.slices(batch, "text"):
                element, edge = packed(*sets_of(part.column("text")), part.num_rows, dtype)
                edge = edge.tolist()
                out_a, out_b, out_j = [], [], []
                for r, (key, a, b) in enumerate(zip(*(part.column(c).to_pylist() for c in ("key", "a", "b")))):
                    if key != now:
                        now, held, parent = key, {}, {}
                    if b is None:
                        held.setdefault(a, []).append(element[edge[r] : edge[r + 1]])
                        continue
                    if connect and find(a) == find(b):
                        continue
                    best = 0.0
                    for x in held.get(a, ()):
                        for y in held.get(b, ()):
                            if len(x) and len(y) and min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                                if len(x) > len(y):
                                    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                                else:
                                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                                best = max(best, both / (len(x) + len(y) - both))
                    if best >= threshold:
                        out_a.append(a)
                        out_b.append(b)
                        out_j.append(best)
                        if connect:
                            parent[find(a)] = find(b)
                if out_a:
                    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_j, pa.float64())], ["a", "b", "jaccard"])

    return rows.mapInArrow(compare, "a long, b long, jaccard double")


def packed(row: np.ndarray, element: np.ndarray, rows: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): the distinct elements of each row, sorted; short sorts, one for each row."""
    edge = np.searchsorted(row, np.arange(rows + 1)).tolist()
    sets = [np.sort(element[a:b]) for a, b in zip(edge, edge[1:])]
    size = [len(x) for x in sets]
    element = np.concatenate(sets) if sets else np.zeros(0, dtype)
    row = np.repeat(np.arange(rows), size)
    new = np.ones(len(element), bool)
    new[1:] = (element[1:] != element[:-1]) | (row[1:] != row[:-1])
    return np.ascontiguousarray(element[new], dtype), np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=rows))])
