"""Where repeats can be: exact pruning shared by operators 5 and 6.

A stretch of ``least`` words that occurs twice has the same winnowing anchors
in both places: in every window of ``least`` words the word k-gram of least
hash is one. Anchors are a few percent of all positions, so only they are
shuffled first; windows whose anchor occurs once in the corpus can't repeat
and are dropped. This loses nothing: equal windows have equal anchors.

Positions of the remaining texts are packed in one integer, document ordinal
and word number, in the order of (doc_id, word).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import kernel as k
from corvane.llm.common import Stored, texts

#: Bits of the word number in a packed position: 2^30 words in a text, 2^33 texts with repeats.
BITS = 30


@dataclass(frozen=True)
class RepeatParams:
    least: int = 50  #: words that a repeat must have
    anchor: int = 16  #: words in an anchor's k-gram


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values, by doubling."""
    width, out = 1, x
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - width : w - width + len(x) - w + 1]) if w > width else out[: len(x) - w + 1]


def _windows(words: k.Words, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-gram hashes, least hash of each window of ``least`` words, whether a window lies in one text)."""
    g = k.grams(words.hash, p.anchor)
    w = p.least - p.anchor + 1
    if len(g) < w:
        return g, np.zeros(0, np.uint64), np.zeros(0, bool)
    low = sliding_min(g, w)
    return g, low, words.doc[: len(low)] == words.doc[p.least - 1 :]


def _anchors(words: k.Words, p: RepeatParams) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-grams that are the least of some window."""
    g, low, ok = _windows(words, p)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = p.least - p.anchor + 1
    # the largest window minimum around a k-gram reaches its hash only if it is that minimum;
    # windows across texts don't count: 0 is below any hash
    up = ~np.where(ok, low, np.uint64(0))
    edge = np.full(w - 1, ~np.uint64(0))
    best = ~sliding_min(np.concatenate([edge, up, edge]), w)
    at = np.flatnonzero((best >= g) & (best > 0))
    return at, g[at]


def repeat_regions(docs: DataFrame, p: RepeatParams, id_col: str, text_col: str) -> tuple[DataFrame, Stored]:
    """(texts, regions): (doc_id, tie, text), and (ordinal, doc_id, tie, anchors) of the texts with repeated anchors.

    ``tie`` is a hash of the text: rows of one id but different texts are different texts.
    """
    src = texts(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    kind = src.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.slices(batch, "text"):
                words = k.Words(part.column("text"))
                at, h = _anchors(words, p)
                if len(at):
                    doc = words.doc[at]
                    take = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("doc_id").take(take), part.column("tie").take(take), pa.array((at - words.first[doc]).astype(np.int32))], ["h", "doc_id", "tie", "pos"])

    anchors = src.mapInArrow(find, f"h long, doc_id {kind}, tie long, pos int")
    same = Window.partitionBy("h").orderBy("doc_id", "tie", "pos")
    twice = anchors.select("*", F.lag("pos").over(same).alias("a"), F.lead("pos").over(same).alias("b")).where("a is not null or b is not null")
    lists = Stored(twice.groupBy("doc_id", "tie").agg(F.collect_set("pos").alias("anchors")), "anchors")
    # ordinals in the order of ids, from the row counts of range partitions
    ranged = Stored(lists.df.repartitionByRange("doc_id", "tie").withColumn("part", F.spark_partition_id()), "ranges")
    lists.drop()
    offsets, total = [], 0
    for row in ranged.df.groupBy("part").count().orderBy("part").collect():
        offsets.append((row["part"], total))
        total += row["count"]
    starts = docs.sparkSession.createDataFrame(offsets, "part int, offset long")  # one row per partition
    number = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "tie"))
    ranged.df = ranged.df.withColumn("n", number).join(F.broadcast(starts), "part").select((F.col("n") + F.col("offset") - 1).alias("ordinal"), "doc_id", "tie", "anchors")
    return src, ranged


def surviving(src: DataFrame, regions: Stored, p: RepeatParams, emit: Callable, schema: str) -> DataFrame:
    """What ``emit(words, alive, packed)`` makes of each batch of texts with repeated anchors.

    ``alive[i]``: the window that begins at word i may repeat. ``packed``: position of each word.
    """
    joined = src.join(regions.df, ["doc_id", "tie"]).select("ordinal", "text", "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.slices(batch, "text"):
                words = k.Words(part.column("text"))
                g, low, ok = _windows(words, p)
                if not ok.any():
                    continue
                size = pc.list_value_length(part.column("anchors")).to_numpy(zero_copy_only=False)
                at = np.repeat(words.first[:-1], size) + part.column("anchors").flatten().to_numpy()
                held = np.full(len(g), ~np.uint64(0))
                held[at] = g[at]
                alive = np.zeros(len(words), bool)
                alive[: len(low)] = ok & (sliding_min(held, p.least - p.anchor + 1) == low)
                ordinal = part.column("ordinal").to_numpy()
                packed = (ordinal[words.doc] << BITS) + np.arange(len(words)) - words.first[words.doc]
                yield from emit(words, alive, packed)

    return joined.mapInArrow(run, schema)


def packed_runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first, number) of each run of consecutive positions; positions ascend."""
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    first = np.r_[0, cut] if len(at) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(at)])
