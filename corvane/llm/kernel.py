"""Vectorised text kernels shared by the corpus operators.

Every kernel works on the raw UTF-8 buffer of an Arrow string column, so a
batch of documents is tokenised and hashed in a few numpy passes without a
Python loop over documents, words or characters.

A *word* is a maximal run of ASCII letters, ASCII digits and bytes of
non-ASCII characters, compared in lower case; everything else separates.
A null text counts as an empty one (no words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same definition of a word as a Java/RE2 regular expression, on lower-case text.
WORD_REGEX = "[a-z0-9\\x{80}-\\x{10FFFF}]+"

#: Text bytes that one numpy pass handles at once (bounds a worker's memory).
SLICE_BYTES = 2 << 20

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = True
_WORD[0x80:] = True

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def _powers(n: int) -> np.ndarray:
    """1, B, B^2 ... modulo 2**64."""
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all its bits (bijective)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def strings(column: pa.Array, lower: bool = True) -> pa.Array:
    """The column as a plain string array without nulls, in lower case if asked."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return pc.utf8_lower(column) if lower else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the buffer of a string array and its n + 1 offsets."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part holds much more than ``limit`` text bytes.

    One row is never cut: a single longer text makes a part of its own.
    """
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


class Words:
    """Words of a batch: hash, byte range and document of each, in order."""

    __slots__ = ("data", "doc", "end", "first", "hash", "n_docs", "start")

    def __init__(self, column: pa.Array, lower: bool = True):
        col = strings(column, lower)
        data, offsets = buffers(col)
        self.data, self.n_docs = data, len(col)
        word = _WORD[data]
        n = len(data)
        edge = np.empty(n + 1, bool)
        if n:
            edge[0], edge[n] = word[0], word[n - 1]
            np.not_equal(word[1:], word[:-1], out=edge[1:n])
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            cut = cut[word[cut] & word[cut - 1]]  # two texts that touch inside a run
            at = np.flatnonzero(edge)
            if len(cut):
                at = np.sort(np.concatenate([at, np.repeat(np.unique(cut), 2)]))
        else:
            at = np.zeros(0, np.int64)
        self.start, self.end = at[0::2], at[1::2]
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        #: first[d] is the index of document d's first word; first[n_docs] their number
        self.first = np.searchsorted(self.start, offsets)
        self.first[-1] = len(self.start)
        self.hash = run_hash(data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def run_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges must be disjoint and ascending."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    longest = int(size.max())
    pow_ = _POW if longest <= len(_POW) else _powers(longest)
    out = np.zeros(len(start), np.uint64)
    if longest <= 48:
        # one pass per character position over the words that are that long
        live = np.arange(len(start))
        for j in range(longest):
            if j:
                live = live[size[live] > j]
            out[live] += (data[start[live] + j].astype(np.uint64) + np.uint64(1)) * pow_[j]
    else:
        total = int(size.sum())
        begin = np.cumsum(size) - size
        inside = np.arange(total) - np.repeat(begin, size)
        term = (data[np.repeat(start, size) + inside].astype(np.uint64) + np.uint64(1)) * pow_[inside]
        out = np.add.reduceat(term, begin)
    return mix(out + size.astype(np.uint64) * _MULT)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` hashes; len - n + 1 of them, by doubling."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    # out = sum over j of hashes[i + j] * B^j, put together from powers of two
    out, have, block, width = None, 0, hashes, 1
    left = n
    while left:
        if left & 1:
            piece = block[have : have + m]
            out = piece.copy() if out is None else out + piece * np.uint64(pow(_BASE, have, 1 << 64))
            have += width
        left >>= 1
        if left:
            block = block[: len(block) - width] + block[width:] * np.uint64(pow(_BASE, width, 1 << 64))
            width *= 2
    return mix(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask over gram starts: those whose ``n`` items lie in one document."""
    ok = np.ones(max(total - n + 1, 0), bool)
    if len(ok) and n > 1:
        for back in range(1, n):
            at = first[1:-1] - back
            ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok
