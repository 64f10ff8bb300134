"""Operator 5, suffix-array dedup: distributed prefix doubling.

The suffixes are those that begin at words; a suffix's rank tells its first h
words from others'. Every round pairs the rank at a position with the rank h
words on, Spark sorts the pairs, equal pairs get one new rank, and positions
whose pair is unique leave: their suffix shares its first 2h words with no
other. Rounds end past the threshold; positions that are left begin a stretch of
``least`` words that occurs at least twice, and neighbouring ones make up the
spans. Ranks of ``first`` words are 64-bit fingerprints made while reading;
from the first sort on, ranks are exact names of pairs.

Positions that can't repeat leave before the first round, see ``regions``.

Defined results: null, empty and short texts have no spans; rows with a null id
are left out. Repeated rows (same id and text) are copies of each other and come
out once, as first copies. Of an id with several texts the word numbers of each
are given. Equal places are told apart by (doc_id, hash of the text, word).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernel as k
from corvane.llm.common import Stored
from corvane.llm.regions import BITS, RepeatParams, repeat_regions, surviving


@dataclass(frozen=True)
class SuffixParams(RepeatParams):
    first: int = 16  #: words that the fingerprint of the first rank covers


def offsets(first: int, least: int) -> list[int]:
    """Growing offsets at which ranks are paired: each round covers the words of both."""
    out, have = [], first
    while have < least:
        step = min(have, least - have)
        out.append(step)
        have += step
    return out


def _rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """New ranks of sorted pairs (r1, r2, at); unique pairs are dropped.

    Equal pairs are in one partition, so partition and running number name them.
    """
    base = TaskContext.get().partitionId() << 40
    rank = 0
    last = np.zeros((0, 3), np.int64)  # the last row so far, if nothing is known of it yet
    before = None  # the pair before the rows at hand
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy() for c in ("r1", "r2", "at")], 1)
        rows = np.concatenate([last, rows])
        same = np.ones(len(rows), bool)  # equal to the row before
        same[1:] = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
        same[0] = before is not None and tuple(rows[0, :2]) == before
        name = rank + np.cumsum(~same)
        keep = same.copy()
        keep[:-1] |= same[1:]
        last = rows[-1:]
        done = len(rows) - 1  # the last row waits for the next batch
        if done:
            before, rank = tuple(rows[done - 1, :2]), int(name[done - 1])
            some = np.flatnonzero(keep[:done])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(rows[some, 2]), pa.array(base + name[some]), pa.array(same[some])], ["at", "rank", "later"])
    if len(last) and before == tuple(last[0, :2]):
        yield pa.RecordBatch.from_arrays([pa.array(last[:, 2]), pa.array([base + rank], pa.int64()), pa.array([True])], ["at", "rank", "later"])


def _pair(step: int):
    """Pairs (rank at a position, rank ``step`` words on) of rows sorted by position."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rank = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            at = np.concatenate([at, batch.column("at").to_numpy()])
            rank = np.concatenate([rank, batch.column("rank").to_numpy()])
            if not len(at):
                continue
            done = int(np.searchsorted(at, at[-1] - step, side="left"))  # later ones may find their partner in the next batch
            if out := _partners(at, rank, done, step):
                yield out
            at, rank = at[done:], rank[done:]
        if out := _partners(at, rank, len(at), step):
            yield out

    return pair


def _partners(at: np.ndarray, rank: np.ndarray, done: int, step: int) -> pa.RecordBatch | None:
    if not done:
        return None
    j = np.minimum(np.searchsorted(at, at[:done] + step), len(at) - 1)
    ok = np.flatnonzero(at[j] == at[:done] + step)
    if not len(ok):
        return None
    return pa.RecordBatch.from_arrays([pa.array(at[ok]), pa.array(rank[ok]), pa.array(rank[j[ok]])], ["at", "r1", "r2"])


def _sorted_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.repartition("r1", "r2").sortWithinPartitions("r1", "r2", "at").mapInArrow(_rerank, "at long, rank long, later boolean")


def by_position(rows: DataFrame) -> DataFrame:
    """Rows of one text in one partition, in order."""
    return rows.repartition(F.shiftright("at", BITS)).sortWithinPartitions("at")


def repeated_spans(docs: DataFrame, params: SuffixParams = SuffixParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words, copy): spans all of whose windows of ``least`` words occur twice or more.

    ``copy``: the windows of the span aren't the first of their kind. Dropping the
    copies leaves every repeated window once.
    """
    p = params
    steps = offsets(p.first, p.least)
    src, regions = repeat_regions(docs, p, id_col, text_col)
    # positions that some later round reads: a surviving window's begin, shifted by sums of later offsets
    shifts = {0}
    for step in steps[1:]:
        shifts |= {s + step for s in shifts}

    def emit(words: k.Words, alive: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        base = k.grams(words.hash, p.first)
        need = np.zeros(len(words) + p.least, bool)
        start = np.flatnonzero(alive)
        for s in shifts:
            need[start + s] = True
        at = np.flatnonzero(need[: len(words)])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(packed[at]), pa.array(base[at].view(np.int64)), pa.array(base[at + steps[0]].view(np.int64))], ["at", "r1", "r2"])

    ranks = Stored(_sorted_pairs(surviving(src, regions, p, emit, "at long, r1 long, r2 long")), "ranks")
    for step in steps[1:]:
        pairs = by_position(ranks.df.select("at", "rank")).mapInArrow(_pair(step), "at long, r1 long, r2 long")
        new = Stored(_sorted_pairs(pairs), "ranks")
        ranks.drop()
        ranks = new

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, later = np.zeros(0, np.int64), np.zeros(0, bool)
        for batch, end in _with_end(batches):
            if batch is not None:
                at = np.concatenate([at, batch.column("at").to_numpy()])
                later = np.concatenate([later, batch.column("later").to_numpy(zero_copy_only=False)])
            if not len(at):
                continue
            new = np.r_[True, at[1:] != at[:-1]]  # repeated rows: the first copy's mark counts
            at, later = at[new], later[new]
            cut = np.r_[True, (np.diff(at) != 1) | (later[1:] != later[:-1])]
            first = np.flatnonzero(cut)
            size = np.diff(np.r_[first, len(at)])
            some = slice(None) if end else slice(0, -1)  # the last run may go on
            out = first[some]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(at[out] >> BITS), pa.array((at[out] & ((1 << BITS) - 1)).astype(np.int32)), pa.array((size[some] + p.least - 1).astype(np.int32)), pa.array(later[out])], ["ordinal", "start_word", "n_words", "copy"])
            at, later = (at[first[-1] :], later[first[-1] :])

    runs = ranks.df.repartition(F.shiftright("at", BITS)).sortWithinPartitions("at", "later").mapInArrow(spans, "ordinal long, start_word int, n_words int, copy boolean")
    done = Stored(runs.join(regions.df.select("ordinal", "doc_id"), "ordinal").select("doc_id", "start_word", "n_words", "copy"), "spans")
    ranks.drop()
    regions.drop()
    return done.df


def _with_end(batches):
    """(batch, False) of each batch, then (None, True)."""
    for batch in batches:
        yield batch, False
    yield None, True
