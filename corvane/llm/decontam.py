"""Operator 3, benchmark decontamination: n-gram seeds, then Smith-Waterman.

All word n-grams of the test items are seeds, however many documents hold them:
an item that was copied often has no rare ones, and its shortened or edited
copies hold just some of them. Each (document, item) pair that shares a seed is
a candidate: a local alignment of words (match +2, mismatch -1, gap -1) between
the item and the stretch of text around the seed. The share of the best possible
score decides; edited or partly reworded copies lose some of it, chance hits
nearly all. Most candidates are chance hits on common n-grams. They go by an upper bound
of the score, from which words of the item the stretch has at all, so nothing
that reaches ``min_score`` is lost to it. What shares no n words in a row with an
item isn't found.

The pass is map-only over the corpus, as query and as filter; the benchmark side is a broadcast of
checked size. Beyond ``max_items_words`` words, the benchmark is cut in slices
and the pass repeats for each, so nothing is dropped and no executor holds
more than one slice.

Defined results: null and word-less items and documents match nothing. An item
shorter than ``n`` words uses its whole text as one seed. Items with the same id
count as separate texts of one id, the better score remains; repeated documents
each match, one row per (doc_id, item_id). Null ids of items or documents are
left out of the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernel as k
from corvane.llm.common import texts

MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass(frozen=True)
class DecontamParams:
    n: int = 3  #: words in a seed
    min_score: float = 0.45  #: share of the best alignment score from which a document is contaminated; chance hits stay below 0.36
    slack: float = 0.5  #: text beyond both ends of the expected place, in item lengths
    max_items_words: int = 4_000_000
    chunk: int = 500_000  #: candidates handled at once, in whole documents


@dataclass
class Bench:
    """Words of a slice of the benchmark and its seeds, sorted by hash."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray

    @cached_property
    def size(self) -> np.ndarray:
        return np.array([len(x) for x in self.words], np.int64)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, ...]:
        """Distinct words; distinct (item, word) pairs, each item's first one, and the pair of each word."""
        vocabulary, of_word = np.unique(np.concatenate(self.words), return_inverse=True)
        pairs, pair = np.unique(np.repeat(np.arange(len(self.size)), self.size) * len(vocabulary) + of_word, return_inverse=True)
        return vocabulary, pairs, np.searchsorted(pairs, np.arange(len(self.size) + 1) * len(vocabulary)), pair


def _bench(column: pa.Array, ids: list, n: int) -> Bench:
    w = k.Words(column)
    words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(column))]
    parts = []
    for i, x in enumerate(words):
        if len(x):
            g = k.grams(x, min(n, len(x)))
            parts.append((g, np.full(len(g), i), np.arange(len(g))))
    if not parts:
        z = np.zeros(0, np.int64)
        return Bench(ids, words, np.zeros(0, np.uint64), z, z)
    seeds, item, at = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((at, item, seeds))
    return Bench(ids, words, seeds[order], item[order], at[order])


def _lookup(distinct: np.ndarray) -> np.ndarray:
    """Bitmap over 22 bits of the seeds: most words of a corpus fail this test at once."""
    bits = np.zeros(1 << 22, bool)
    bits[(distinct >> np.uint64(42)).astype(np.int64)] = True
    return bits


def _hits(words: k.Words, distinct: np.ndarray, bits: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, index into ``distinct``) of every n-gram of a batch that is a seed."""
    where, which = [], []
    for n in sizes:
        g = k.grams(words.hash, n)
        at = np.flatnonzero(bits[(g >> np.uint64(42)).astype(np.int64)])
        at = at[words.doc[at] == words.doc[at + n - 1]]
        j = np.searchsorted(distinct, g[at])
        ok = distinct[np.minimum(j, len(distinct) - 1)] == g[at]
        where.append(at[ok])
        which.append(j[ok])
    return np.concatenate(where), np.concatenate(which)


def align(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local alignment score of ``item`` in each row of ``windows`` (0 pads)."""
    b, m = windows.shape
    ramp = (np.arange(m, dtype=np.int32) * -GAP)[None, :]
    row = np.zeros((b, m), np.int32)
    best = np.zeros(b, np.int32)
    for x in item:
        diag = np.zeros_like(row)
        diag[:, 1:] = row[:, :-1]
        cell = np.maximum(diag + np.where(windows == x, MATCH, MISMATCH), row + GAP)
        np.maximum(cell, 0, out=cell)
        # gaps along the row: best of cell[k] + GAP * (j - k) over k <= j
        row = np.maximum.accumulate(cell + ramp, 1) - ramp
        np.maximum(best, row.max(1), out=best)
    return best


def _windows(words: k.Words, bench: Bench, at: np.ndarray, rows: np.ndarray, slack: float) -> tuple[np.ndarray, ...]:
    """(document, item, from, to) of the stretches to align; overlapping ones of a pair are joined."""
    item = bench.seed_item[rows]
    length = bench.size[item]
    pad = np.ceil(length * slack).astype(np.int64) + 2
    doc = words.doc[at]
    low = np.maximum(at - bench.seed_at[rows] - pad, words.first[doc])
    high = np.minimum(at - bench.seed_at[rows] + length + pad, words.first[doc + 1])
    order = np.lexsort((low, item, doc))
    doc, item, low, high = doc[order], item[order], low[order], high[order]
    if not len(doc):
        return doc, item, low, high
    new = np.ones(len(doc), bool)
    pair_new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]
    # the reach so far, kept apart between pairs by a growing base
    base = np.cumsum(pair_new) * (len(words) + 1)
    reach = np.maximum.accumulate(high + base)
    new[1:] = pair_new[1:] | (low[1:] + base[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], item[begin], low[begin], np.maximum.reduceat(high, begin)


def _bounds(words: k.Words, bench: Bench, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bound of the alignment score of each stretch.

    An alignment covers some run of the item's words; those that the stretch has give at
    most MATCH, each other one costs a mismatch or a gap. The best run is the bound.
    """
    out = np.zeros(len(item), np.int64)
    if not len(item):
        return out
    size = bench.size
    start = np.cumsum(size) - size
    vocabulary, pairs, first, pair = bench.pairs
    number = np.searchsorted(vocabulary, words.hash)
    number[vocabulary[np.minimum(number, len(vocabulary) - 1)] != words.hash] = -1
    load = np.cumsum(high - low + size[item])
    cuts = np.flatnonzero(np.diff(load // 2_000_000)) + 1  # of some 2 million words each
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(item)]):
        it, width = item[a:b], (high - low)[a:b]
        of = np.repeat(np.arange(b - a), width)
        no = number[np.repeat(low[a:b] - np.cumsum(width) + width, width) + np.arange(len(of))]
        of, no = of[no >= 0], no[no >= 0]
        key = it[of] * len(vocabulary) + no
        j = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        hit = pairs[j] == key
        many = first[it + 1] - first[it]
        at = np.cumsum(many) - many
        held = np.zeros(int(many.sum()), bool)
        held[(at - first[it])[of[hit]] + j[hit]] = True
        # gain of each word of each stretch's item, and the best sum of a run of them
        length = size[it]
        of = np.repeat(np.arange(b - a), length)
        place = np.repeat(start[it] - np.cumsum(length) + length, length) + np.arange(len(of))
        gain = np.where(held[(at - first[it])[of] + pair[place]], MATCH, max(MISMATCH, GAP))
        total = np.cumsum(gain)
        # the least sum before a run, kept apart between stretches by a falling base
        base = of * (4 * MATCH * len(of) + 1)
        run = total - base - np.minimum.accumulate(total - gain - base)
        out[a:b] = np.maximum(np.maximum.reduceat(run, np.cumsum(length) - length), 0)
    return out


def _aligned(words: k.Words, bench: Bench, at: np.ndarray, rows: np.ndarray, slack: float, least: float) -> tuple[np.ndarray, ...]:
    """(document, item, score share) of each stretch that may reach the share ``least``."""
    doc, item, low, high = _windows(words, bench, at, rows, slack)
    some = np.flatnonzero(_bounds(words, bench, item, low, high) >= least * MATCH * bench.size[item] - 1e-6)
    doc, item, low, high = doc[some], item[some], low[some], high[some]
    share = np.zeros(len(doc))
    order = np.lexsort((high - low, item))
    cuts = np.flatnonzero(np.diff(item[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        x = bench.words[item[group[0]]]
        width = high[group] - low[group]
        a = 0
        while a < len(group):  # at most 2 million cells wide at once
            b = min(len(group), a + max(1, 2_000_000 // max(int(width[a:].max()), 1)))
            some, wide = group[a:b], int(width[a:b].max())
            idx = low[some][:, None] + np.arange(wide)[None, :]
            win = np.where(idx < high[some][:, None], words.hash[np.minimum(idx, len(words) - 1)], np.uint64(0))
            share[some] = align(x, win) / (MATCH * len(x))
            a = b
    return doc, item, share


def _slices(bench: DataFrame, p: DecontamParams, item_col: str, item_text: str) -> Iterator[Bench]:
    """The benchmark in slices of checked size, by the hash of the id."""
    items = texts(bench, item_col, item_text).where(F.col("doc_id").isNotNull())
    size = items.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    slices = int(size // p.max_items_words) + 1
    for s in range(slices):
        part = items.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == s).select("doc_id", "text").toArrow().combine_chunks()
        part = part.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        column = part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string())
        yield _bench(column, part.column("doc_id").to_pylist(), p.n)


class _Search:
    """Copies of a slice of the benchmark in batches of texts; made once in a task."""

    def __init__(self, bench: Bench, p: DecontamParams):
        self.bench, self.p = bench, p
        self.sizes = sorted({min(p.n, len(x)) for x in bench.words if len(x)})
        self.distinct, self.begin, self.many = np.unique(bench.seeds, return_index=True, return_counts=True)
        self.bits = _lookup(self.distinct)

    def __call__(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, share) of stretches that reach ``min_score``."""
        p, many = self.p, self.many
        words = k.Words(column)
        at, which = _hits(words, self.distinct, self.bits, self.sizes)
        if not len(at):
            return
        order = np.argsort(at, kind="stable")
        at, which = at[order], which[order]
        # candidates of whole documents, so that the stretches of a pair stay together
        load = np.cumsum(np.bincount(words.doc[at], many[which], words.n_docs)).astype(np.int64)
        ends = np.r_[np.flatnonzero(np.diff(load // p.chunk)), words.n_docs - 1] + 1
        cuts = np.searchsorted(words.doc[at], ends)
        for a, b in zip([0, *cuts.tolist()], cuts.tolist()):
            if a == b:
                continue
            repeat = many[which[a:b]]  # a seed may be in several places of several items
            total = np.cumsum(repeat)
            rows = np.arange(total[-1]) - np.repeat(total - repeat, repeat) + np.repeat(self.begin[which[a:b]], repeat)
            doc, item, share = _aligned(words, self.bench, np.repeat(at[a:b], repeat), rows, p.slack, p.min_score)
            ok = share >= p.min_score
            if ok.any():
                yield doc[ok], item[ok], share[ok]


def find_leaks(docs: DataFrame, bench: DataFrame, params: DecontamParams = DecontamParams(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score): pairs of a document and a test item it holds a copy of."""
    src = texts(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    kind, item_kind = src.schema["doc_id"].dataType.simpleString(), bench.schema[item_col].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, score double")
    for b in _slices(bench, params, item_col, item_text):
        if len(b.seeds):
            out = out.unionByName(_pairs(src, b, params, kind, item_kind))
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def _pairs(src: DataFrame, bench: Bench, p: DecontamParams, kind: str, item_kind: str) -> DataFrame:
    shared = src.sparkSession.sparkContext.broadcast(bench)
    ids_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(item_kind)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Search(shared.value, p)
        ids = pa.array(find.bench.ids, ids_type)
        for batch in batches:
            for part in k.slices(batch, "text"):
                for doc, item, share in find(part.column("text")):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), ids.take(pa.array(item)), pa.array(share)], ["doc_id", "item_id", "score"])

    return src.mapInArrow(search, f"doc_id {kind}, item_id {item_kind}, score double")


def drop_leaks(docs: DataFrame, bench: DataFrame, params: DecontamParams = DecontamParams(), text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a copy of a test item, all their columns; a filter, no join and no shuffle.

    Each row is judged by its text alone: rows with a null id are judged too, and of an id with
    several texts only those that hold a copy go. Null and empty texts stay.
    """
    p, out = params, docs
    for b in _slices(bench, p, item_col, item_text):
        if not len(b.seeds):
            continue
        shared = docs.sparkSession.sparkContext.broadcast(b)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = _Search(shared.value, p)
            for batch in batches:
                for part in k.slices(batch, text_col):
                    keep = np.ones(part.num_rows, bool)
                    for doc, _, _ in find(part.column(text_col)):
                        keep[doc] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out
