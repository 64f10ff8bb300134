"""Operator 9, line dedup: fuzzy lines by MinHash of character shingles.

Lines are trimmed, put in lower case and collapse by a 128-bit hash first, so the rest
works on distinct lines. Their character shingles are MinHashed; a high-recall
banding gives candidates, exact Jaccard of the whole shingle sets verifies
them, distributed union-find joins what is left, and of each component only
its first line (lowest document id, then line number) stays.

Bands share signature values, two bands one value at most: as many bands cost fewer hashes.
Lines that just happen to share a bucket grow with the square of the corpus, so each member brings
64 bits of its signature: only pairs that are close in them are likely ones. A bucket gives the
shortest forest of its likely pairs and not all of them. The lines that such edges connect, mostly a few, come
together in one task, which compares them all by their whole sets. Where they are too many for a task, the edges are verified
in tiled blocks, and a tree with an edge that is refused is opened again: its members that are still apart
are compared with all others of the tree. Either way the components are those of all likely pairs at least.

Defined results: null and empty texts have no lines; blank lines are never
duplicates. A line shorter than a shingle is one shingle, all of it. Rows with
a null id are left out of the result and of the search. Repeated rows of one id
count as one document, so their lines aren't copies of each other. Ids may be of
any atomic type and should name one text each: of an id with several texts, a line number means that line of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import kernel as k
from corvane.llm.common import Stored, fresh, texts
from corvane.llm.components import connected_components
from corvane.llm.forest import spanning_forest
from corvane.llm.verify import packed, verified_pairs


#: Bits of a sketch.
BITS = 64


@dataclass(frozen=True)
class LineParams:
    n: int = 8  #: bytes in a shingle
    threshold: float = 0.7
    bands: int = 20  #: an even number
    rows: int = 5  #: 20 bands of 5, each value in two of them, find a pair at 0.7 with probability 0.953, at 0.75 with 0.987, at 0.8 with 0.998
    tolerance: float = 0.002  #: probability that a pair at the threshold differs in too many bits of its sketch
    partition: int = 64 << 20  #: bytes of band rows in a partition
    seed: int = 5

    def __post_init__(self):
        if self.bands % 2 or self.bands // 2 < self.rows:
            raise ValueError("bands must be even and twice rows at least")

    @property
    def values(self) -> int:
        return self.bands // 2 * self.rows

    def value(self, band: int, row: int) -> int:
        """Which signature value: rows of a grid, then its diagonals, so that two bands share one value at most."""
        half = self.bands // 2
        return (band % half + (row if band >= half else 0)) % half * self.rows + row

    @property
    def most_bits(self) -> int:
        """Differing sketch bits up to which a pair is a candidate."""
        p, lost = (1 - self.threshold) / 2, 0.0
        for d in range(BITS, -1, -1):
            lost += comb(BITS, d) * p**d * (1 - p) ** (BITS - d)
            if lost > self.tolerance:
                return d
        return 0


#: Near copies, those of short lines too: a changed word takes its length + n - 1 shingles along, at 8 bytes too many of a line under 120.
NEAR = LineParams(n=5)

#: Lines that a task remembers; when there are more it forgets those seen once.
REMEMBERED = 400_000
#: Members of a tree in one row of the table of trees.
LIST = 4096
#: Partitions that the places of a frequent line are spread over at most.
SPREAD = 64
#: Connected lines that one task compares with each other at most, and the bytes of their texts.
TOGETHER, TOGETHER_BYTES = 4096, 4 << 20
#: Members of a bucket up to which its forest is the shortest one.
SHORTEST = 1024


def char_shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets): 32-bit hashes of the byte windows of each line, none across lines."""
    data, offsets = k.buffers(k.strings(column, lower=False))
    size = np.diff(offsets)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    at = np.cumsum(count) - count
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
    # hash of n bytes from every place, put together from powers of two as k.grams does
    rolled, have, width, left, base = None, 0, 1, n, 0x01000193
    block = data.astype(np.uint32)
    places = max(len(data) - n + 1, 0)
    while left:
        if left & 1:
            piece = block[have : have + places]
            rolled = piece.copy() if rolled is None else rolled * np.uint32(pow(base, width, 1 << 32)) + piece
            have += width
        left >>= 1
        if left:
            block = block[: max(len(block) - width, 0)] * np.uint32(pow(base, width, 1 << 32)) + block[width:]
            width *= 2
    # windows that begin in a line and end in it, picked without a loop over lines
    edge = np.zeros(len(data) + 1, np.int8)
    long = np.flatnonzero(size >= n)
    edge[offsets[long]] += 1
    edge[offsets[long] + count[long]] -= 1  # no two long lines end or begin their windows in one place
    out = np.empty(total, np.uint32)
    pos = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    whole = size >= n
    short = np.flatnonzero((size > 0) & ~whole)
    if len(short):
        mask = np.ones(total, bool)
        mask[at[short]] = False
        out[mask] = rolled[pos]
        out[at[short]] = (k.run_hash(data, offsets[short], offsets[short + 1]) >> np.uint64(32)).astype(np.uint32)
    else:
        out[:] = rolled[pos]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    out *= np.uint32(0x297A2D39)
    out ^= out >> np.uint32(15)
    return out, np.r_[at, total]


def line_keys(column: pa.Array, p: LineParams) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, lines x bands; sketches of 64 bits) of non-empty lines."""
    rng = np.random.default_rng(p.seed)
    mult = rng.integers(0, 1 << 31, p.values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    x, offsets = char_shingles(column, p.n)
    start = offsets[:-1]
    value = np.empty((p.values, len(column)), np.uint32)
    scaled = np.empty_like(x)
    for v in range(p.values):
        # odd multipliers permute the hashes
        np.minimum.reduceat(np.multiply(x, mult[v], out=scaled), start, out=value[v])
    keys = np.empty((len(column), p.bands), np.uint64)
    for b in range(p.bands):
        key = np.full(len(column), b + 1, np.uint64)
        for r in range(p.rows):
            # a fingerprint of all rows of the band, spread by one mix
            key = key * np.uint64(0x9E3779B97F4A7C15) + value[p.value(b, r)]
        keys[:, b] = k.mix(key)
    sketch = np.zeros(len(column), np.uint64)
    for bit in range(BITS):
        # a bit of every value, then another bit of the first ones
        sketch |= (value[bit % p.values] >> np.uint32(3 + bit // p.values) & np.uint32(1)).astype(np.uint64) << np.uint64(bit)
    return keys, sketch


def split_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, line number, line) of the lines that aren't blank: lower case, tabs and returns as blanks, trimmed."""
    data, offsets = k.buffers(k.strings(column))
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.string())
    data = _PLAIN[data]
    brk = np.flatnonzero(data == 10)
    solid = np.flatnonzero((data != 32) & (data != 10))
    # a line begins with its text or after a break; those at the same place are empty
    start = np.sort(np.concatenate([offsets[:-1], brk + 1]))
    end = np.r_[start[1:], n]
    row = np.searchsorted(offsets, start, side="right") - 1
    number = np.searchsorted(brk, start) - np.searchsorted(brk, offsets[row])
    a = np.searchsorted(solid, start)
    b = np.searchsorted(solid, end) - 1
    live = np.flatnonzero(b >= a)
    first, last = solid[a[live]], solid[b[live]] + 1
    mark = np.zeros(n + 1, np.int8)
    mark[first] += 1
    np.subtract.at(mark, last, 1)
    inside = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
    size = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    lines = pa.Array.from_buffers(pa.string(), len(live), [None, pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return row[live], number[live].astype(np.int32), lines


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[9, 13]] = 32


def _digests(line: pa.Array) -> np.ndarray:
    """128 bits of each line, as two integers."""
    raw = b"".join([blake2b(x, digest_size=16).digest() for x in line.cast(pa.binary()).to_pylist()])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of documents by their hashes; of equal lines in a task only the first, a second place of it, and
    every place below all before have the line itself: a line that millions of documents hold so
    travels a few times for each task, not once for each document."""
    seen: dict[tuple[int, int], tuple] = {}  # line -> least place, whether it had another one
    for batch in batches:
        for part in k.slices(batch, "text"):
            row, number, line = split_lines(part.column("text"))
            if not len(row):
                continue
            h = _digests(line)
            doc = part.column("doc_id").take(pa.array(row))
            keep = np.ones(len(row), bool)
            for i, (x, place) in enumerate(zip(zip(*h.T.tolist()), zip(doc.to_pylist(), number.tolist()))):
                if (before := seen.get(x)) is None:
                    seen[x] = (place, False)
                elif place == before[0] or before[1] and place > before[0]:
                    keep[i] = False
                else:
                    seen[x] = (min(place, before[0]), True)
            if len(seen) > REMEMBERED:
                seen = {x: y for x, y in seen.items() if y[1]}
                if len(seen) > REMEMBERED // 2:
                    seen = {}
            line = pc.if_else(pa.array(keep), line, pa.scalar(None, line.type))
            yield pa.RecordBatch.from_arrays([doc, pa.array(number), pa.array(h[:, 0]), pa.array(h[:, 1]), line], ["doc_id", "line_no", "h1", "h2", "line"])


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, h1, h2, line); both hashes together tell lines apart."""
    src = texts(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_rows, f"doc_id {kind}, line_no int, h1 long, h2 long, line string")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by line and place -> one row for each line: its number, its first place, and how many it has."""
    base, given = TaskContext.get().partitionId() << 32, 0
    names = ["h1", "h2", "doc_id", "line_no", "line"]
    held, count, last = None, 0, None  # the line at hand, its places so far, the last of them
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, no = (batch.column(c).to_numpy() for c in ("h1", "h2", "line_no"))
        doc = batch.column("doc_id")
        new, place = np.ones(len(h1), bool), np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        # a repeated row of one place isn't a second line
        place[1:] = new[1:] | (no[1:] != no[:-1]) | pc.not_equal(doc.slice(1), doc.slice(0, len(doc) - 1)).to_numpy(zero_copy_only=False)
        if held is not None and (held.column("h1")[0].as_py(), held.column("h2")[0].as_py()) == (int(h1[0]), int(h2[0])):
            new[0] = False
            place[0] = last != (doc[0].as_py(), int(no[0]))
        first = np.flatnonzero(new)
        total = np.concatenate([[0], np.cumsum(place)])
        count += int(total[first[0] if len(first) else len(h1)])
        last = (doc[-1].as_py(), int(no[-1]))
        if not len(first):
            continue
        done = batch.select(names).take(pa.array(first[:-1]))
        counts = np.diff(total[first])
        if held is not None:
            done = pa.Table.from_batches([held, done]).combine_chunks().to_batches()[0]
            counts = np.r_[count, counts]
        if done.num_rows:
            ids = base + given + np.arange(done.num_rows)
            given += done.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts.astype(np.int64)), *done.columns], ["id", "n", *names])
        held = batch.select(names).take(pa.array(first[-1:]))
        count = int(total[-1] - total[first[-1]])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([base + given], pa.int64()), pa.array([count], pa.int64()), *held.columns], ["id", "n", *names])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by line and place -> those of ``_distinct``, and of each other place its hashes, without id, number and line."""
    rest: list = []

    def kept() -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            held = batch.column("line").is_valid().to_numpy(zero_copy_only=False)
            first = np.r_[last != (int(h1[0]), int(h2[0])), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] & held
            last = int(h1[-1]), int(h2[-1])
            other = batch.filter(pa.array(~first))
            if n := other.num_rows:
                none = pa.nulls(n, pa.int64())
                names = ["h1", "h2", "doc_id", "line_no"]
                rest.append(pa.RecordBatch.from_arrays([none, none, *(other.column(c) for c in names), pa.nulls(n, pa.string())], ["id", "n", *names, "line"]))
            yield batch if held.all() else batch.filter(pa.array(held))

    for done in _distinct(kept()):
        yield done
        while rest:
            yield rest.pop()
    yield from rest


#: Bytes of a band row.
ROW = 17


def _bucketed(p: LineParams, buckets: int):
    """(bucket, base, rows): band rows of a slice of lines, packed by the bucket of the key.

    A band row is 17 bytes: 40 bits of the key, 32 of the line's number above ``base``, the sketch.
    A packed row stands for hundreds of them; Spark shuffles them as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.slices(batch, "line", 1 << 20):  # a quarter faster than 2 MB: the hashes stay in the cache
                keys, sketch = line_keys(part.column("line"), p)
                ids = part.column("id").to_numpy()
                base = ids >> 32 << 32
                for b in np.unique(base).tolist():
                    at = np.flatnonzero(base == b)
                    key = keys[at].ravel()
                    bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint32)
                    order = np.argsort(bucket, kind="stable")
                    bucket = bucket[order]
                    row = np.empty((len(key), ROW), np.uint8)
                    row[:, :5] = key.view(np.uint8).reshape(-1, 8)[:, :5]
                    row[:, 5:9] = np.repeat((ids[at] - b).astype(np.uint32), p.bands).view(np.uint8).reshape(-1, 4)
                    row[:, 9:] = np.repeat(sketch[at], p.bands).view(np.uint8).reshape(-1, 8)
                    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                    offsets = np.r_[first, len(bucket)].astype(np.int32) * ROW
                    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(row[order])])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(np.full(len(first), b)), packed], ["bucket", "base", "rows"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key with its bucket, id, sketch) of all band rows of a partition, sorted by key and id."""
    key, ids, sketch = [], [], []
    for batch in batches:
        column = batch.column("rows")
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, ROW)
        many = np.diff(offsets) // ROW
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw[:, :5]
        key.append(wide.view(np.int64).ravel() | np.repeat(batch.column("bucket").to_numpy().astype(np.int64) << 40, many))
        ids.append(np.ascontiguousarray(raw[:, 5:9]).view(np.uint32).ravel() + np.repeat(batch.column("base").to_numpy(), many))
        sketch.append(np.ascontiguousarray(raw[:, 9:]).view(np.uint64).ravel())
    if not key:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key, ids, sketch = (np.concatenate(x) for x in (key, ids, sketch))
    order = np.argsort(key)
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    live = ~first | np.r_[~first[1:], False]  # keys of one line are done
    key, order = key[live], order[live]
    ids, sketch = ids[order], sketch[order]
    order = np.lexsort((ids, key))
    return key[order], ids[order], sketch[order]


def bucket_forests(first: np.ndarray, size: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, tree): edges that connect what all likely pairs of each bucket connect, and of each member the first one of its tree.

    Bucket b: the places ``first[b]`` to ``first[b] + size[b]``. Buckets of about one size are done together, by Prim's
    algorithm: the edges are the closest pairs, which verification refuses least. Only a bucket beyond ``SHORTEST`` members,
    where that is slow, gives a star of its first member, and of those apart from it any edges.
    """
    tree, left, right = np.arange(len(sketch)), [], []
    width = np.where(size <= 8, size, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    for w in np.unique(width[(size > 1) & (size <= SHORTEST)]).tolist():
        held = np.flatnonzero(width == w)
        for low in range(0, len(held), max(1, 500_000 // w)):
            some = held[low : low + max(1, 500_000 // w)]
            live = np.arange(w) < size[some, None]
            at = first[some, None] + np.where(live, np.arange(w), 0)
            bits, row = sketch[at], np.arange(len(some))
            done = ~live
            done[:, 0] = True
            best = np.bitwise_count(bits ^ bits[:, :1])
            best[done] = 255
            near = np.zeros(at.shape, np.int16)
            label = np.zeros(at.shape, np.int16)
            for _ in range(int(size[some].max()) - 1):
                i = best.argmin(1)
                d, j = best[row, i], near[row, i]
                edge = d <= most
                left.append(at[row[edge], i[edge]])
                right.append(at[row[edge], j[edge]])
                # none is near: a new tree begins
                label[row, i] = np.where(edge, label[row, j], np.where(d < 255, i, label[row, i]))
                done[row, i] = True
                now = np.bitwise_count(bits ^ bits[row, i][:, None])
                now[done] = best[done] = 255
                closer = now < best
                best[closer] = now[closer]
                near[closer] = np.broadcast_to(i[:, None], near.shape)[closer]
            tree[at[live]] = at[row[:, None], label][live]
    for b in np.flatnonzero(size > SHORTEST).tolist():
        bits = sketch[first[b] : first[b] + size[b]]
        close = np.bitwise_count(bits ^ bits[0]) <= most
        order = np.argsort(close, kind="stable")  # those apart first: the rest need no rows of their own
        bits, label = bits[order], np.where(close, size[b], np.arange(size[b]))[order]
        i, j, label = spanning_forest(label, lambda i, j: np.ones(len(i), bool), lambda i, j: np.bitwise_count(bits[i] ^ bits[j]) <= most)  # noqa: B023
        star = np.flatnonzero(close)[1:]
        left += [first[b] + star, first[b] + order[i]]
        right += [np.full(len(star), first[b]), first[b] + order[j]]
        _, begin, label = np.unique(label, return_index=True, return_inverse=True)
        tree[first[b] + order] = first[b] + order[begin[label]]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none), tree


def _trees(p: LineParams):
    """Band rows of whole buckets -> edges (a, b, key) of forests, and members (key, ids, sketches) of trees of three or more.

    The key of an edge is that of its tree, null in a tree of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sketch = _unpacked(batches)
        if not len(key):
            return
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        a, b, tree = bucket_forests(first, np.diff(np.r_[first, len(key)]), sketch, p.most_bits)
        many = (np.bincount(tree, minlength=len(tree)) > 2)[tree]
        key = k.mix(key.view(np.uint64) + ids[tree].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)  # of the bucket and of the tree's first member
        none = lambda n: pa.nulls(n, pa.list_(pa.int64()))
        names = ["a", "b", "key", "ids", "sketches"]
        for low in range(0, len(a), 500_000):
            x, y = a[low : low + 500_000], b[low : low + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y])), pa.array(key[x], mask=~many[x]), none(len(x)), none(len(x))], names)
        at = np.flatnonzero(many)
        if not len(at):
            return
        # of long trees several rows
        at = at[np.argsort(tree[at], kind="stable")]
        start = np.flatnonzero(np.r_[True, tree[at][1:] != tree[at][:-1]])
        inside = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
        begin = np.flatnonzero(inside % LIST == 0)
        for low in range(0, len(begin), 100_000):
            some = begin[low : low + 100_000]
            end = begin[low + 100_000] if low + 100_000 < len(begin) else len(at)
            rows = at[some[0] : end]
            offsets = pa.array((np.r_[some, end] - some[0]).astype(np.int32))
            n = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([n, n, pa.array(key[at[some]]), *(pa.ListArray.from_arrays(offsets, pa.array(x[rows].view(np.int64))) for x in (ids, sketch))], names)

    return run


def _again(trees: DataFrame, roots: DataFrame, p: LineParams) -> DataFrame:
    """(a, b): likely pairs of unequal components in the trees that have a refused edge."""
    of = lambda c, x: roots.select(F.col("node").alias(c), F.col("root").alias(x))
    edges = trees.where("a is not null and key is not null").select("a", "b", "key").join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left")
    opened = edges.where("ra is null or rb is null or ra != rb").select("key").distinct()
    members = trees.where("a is null").join(opened, "key", "left_semi").select("key", F.explode(F.arrays_zip("ids", "sketches")).alias("m"))
    members = members.select("key", F.col("m.ids").alias("id"), F.col("m.sketches").alias("sketch")).join(of("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    sized = members.repartition("key").withColumn("like", F.count("*").over(Window.partitionBy("key", "label")))
    every = Window.partitionBy("key")
    sized = sized.withColumn("most", F.max_by("label", F.struct("like", "label")).over(every)).withColumn("total", F.count("*").over(every)).where("like < total")
    kept = Stored(sized.select("key", "id", "sketch", "label", (F.col("label") != F.col("most")).alias("loose")), "open")
    left = kept.df.where("loose").select("key", F.col("id").alias("x"), F.col("sketch").alias("sx"), F.col("label").alias("lx"))
    pairs = left.join(kept.df, "key").where((F.col("lx") != F.col("label")) & (~F.col("loose") | (F.col("x") < F.col("id"))) & (F.bit_count(F.col("sx").bitwiseXOR(F.col("sketch"))) <= p.most_bits))
    return pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()


def _compared(p: LineParams):
    """Lines sorted by ``root`` -> (node, root): the components of all pairs of equal root that reach the threshold, without
    single lines; a null node and the root, where the lines are too long for one task."""
    sets_of, most = _sets(p.n), TOGETHER_BYTES

    def joined(ids: np.ndarray, sets: list) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in sets])
        if len(ids) == 2:
            x, y = sets if size[0] > size[1] else sets[::-1]
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            same = both >= p.threshold * (len(x) + len(y) - both)
            return (ids, np.full(2, ids[0])) if same else (ids[:0], ids[:0])
        root, rest, queue = np.full(len(ids), -1), np.arange(len(ids)), []
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.split(flat, np.cumsum(size)[:-1])
        there = np.zeros(int(flat.max()) + 1, bool)
        while len(rest):
            # each line is once compared with those that no line before it reached
            if queue:
                at = queue.pop()
            else:
                at, rest, queue = rest[0], rest[1:], []
                root[at] = at
                flat = np.concatenate([own[i] for i in rest]) if len(rest) else flat[:0]
            if not len(rest):
                break
            there[own[at]] = True
            both = np.add.reduceat(there[flat], np.cumsum(size[rest]) - size[rest], dtype=np.int64)
            there[own[at]] = False
            near = both >= p.threshold * (size[rest] + size[at] - both)
            if near.any():
                root[rest[near]] = root[at]
                queue += rest[near].tolist()
                flat, rest = flat[np.repeat(~near, size[rest])], rest[~near]
        many = np.bincount(root, minlength=len(ids))[root] > 1
        return ids[many], ids[root[many]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, size = None, [], [], 0
        out_node, out_root = [], []

        def flush() -> None:
            if size > most:
                out_node.append(pa.nulls(1, pa.int64()))
                out_root.append(pa.array([now]))
            elif len(ids) > 1:
                node, root = joined(np.array(ids), sets)
                out_node.append(pa.array(node))
                out_root.append(pa.array(root))

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(out_node), pa.concat_arrays(out_root)], ["node", "root"])

        for batch in batches:
            for part in k.slices(batch, "text"):
                element, edge = packed(*sets_of(part.column("text")), part.num_rows, np.uint32)
                edge = edge.tolist()
                many = pc.binary_length(part.column("text")).to_pylist()
                for r, (root, i) in enumerate(zip(part.column("root").to_pylist(), part.column("id").to_pylist())):
                    if root != now:
                        flush()
                        now, ids, sets, size = root, [], [], 0
                    size += many[r]
                    if size > most:
                        ids, sets = [], []
                    else:
                        ids.append(i)
                        sets.append(element[edge[r] : edge[r + 1]])
                if out_node:
                    yield done()
                    out_node, out_root = [], []
        flush()
        if out_node:
            yield done()

    return run


def _in_blocks(trees: DataFrame, first: DataFrame, linked: DataFrame, nodes: DataFrame, p: LineParams) -> Stored:
    """(node, root): the components among ``nodes``, which are too many for one task; their edges are verified, then what refused ones leave open."""
    mine = lambda table, c: table.join(nodes, F.col("node") == c, "left_semi")
    lines = Stored(mine(linked, F.col("id")).select("id", "text"), "crowded")
    sizes = lines.df.select("id", F.length("text").alias("size"))
    attach = lambda lists: lines.df.join(lists.hint("shuffle_hash"), F.col("id") == F.col("d"))
    verified = lambda pairs: verified_pairs(pairs, attach, sizes, _sets(p.n), p.threshold, tile_size=4_000_000, dtype=np.uint32, connect=True).select("a", "b")
    edges = Stored(verified(mine(first, F.col("a"))), "line_edges")
    roots = connected_components(edges.df)
    again = Stored(_again(mine(trees, F.coalesce("a", F.col("ids")[0])), roots.df, p), "line_pairs")
    if not again.df.isEmpty():
        more = Stored(edges.df.unionByName(verified(again.df)), "line_edges")
        roots.drop()
        roots = connected_components(more.df)
        more.drop()
    for table in (edges, again, lines):
        table.drop()
    return roots


def duplicate_lines(docs: DataFrame, params: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, keep_doc_id, keep_line_no): each line that goes, and the line that stays for it."""
    p = params
    lines = _lines(docs, id_col, text_col)
    kind = lines.schema["doc_id"].dataType.simpleString()
    # places without the line needn't meet it: those of a frequent one are spread
    spread = F.when(F.col("line").isNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
    ordered = lines.repartition("h1", "h2", spread).sortWithinPartitions("h1", "h2", "doc_id", "line_no", F.col("line").isNull())
    places = Stored(ordered.mapInArrow(_placed, f"id long, n long, h1 long, h2 long, doc_id {kind}, line_no int, line string"), "lines")
    distinct = places.df.where("id is not null")

    # partitions of bounded size, however many lines there are
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() * p.bands * ROW // p.partition))
    bands = distinct.select("id", "line").mapInArrow(_bucketed(p, buckets), "bucket int, base long, rows binary").repartitionById(buckets, "bucket")
    trees = Stored(bands.mapInArrow(_trees(p), "a long, b long, key long, ids array<long>, sketches array<long>"), "trees")
    first = Stored(trees.df.where("a is not null").select("a", "b").distinct(), "line_pairs")
    likely = connected_components(first.df)
    sized = likely.df.select(F.col("node").alias("d"), F.when(F.count("*").over(Window.partitionBy("root")) <= TOGETHER, F.col("root")).alias("root"))
    # all lines are shuffled: the same plan, and the same cost per byte, at every size; the narrow side is hashed, so they aren't sorted
    linked = Stored(distinct.select("id", F.col("line").alias("text")).join(sized.hint("shuffle_hash"), F.col("id") == F.col("d")).select("id", "text", "root"), "linked")
    together = linked.df.where("root is not null").repartition("root").sortWithinPartitions("root", "id")
    roots = Stored(together.mapInArrow(_compared(p), "node long, root long"), "roots")
    crowded = likely.df.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("root")
    open_ = Stored(crowded.unionByName(roots.df.where("node is null").select("root")), "open")
    tables = [likely, first, trees, linked, open_]
    if not open_.df.isEmpty():
        more = _in_blocks(trees.df, first.df, linked.df, likely.df.join(open_.df, "root", "left_semi").select("node"), p)
        tables += [roots, more]
        roots = Stored(roots.df.where("node is not null").unionByName(more.df), "roots")
    for table in tables:
        table.drop()
    firsts = distinct.select("id", "h1", "h2", F.struct("doc_id", "line_no").alias("first"), "n")
    # only lines that have another one: in a component, or in several places
    grouped = Stored(firsts.join(roots.df.withColumnRenamed("node", "id").hint("shuffle_hash"), "id", "left").where("root is not null or n > 1").withColumn("root", F.coalesce("root", "id")), "groups")
    roots.drop()
    kept = grouped.df.groupBy("root").agg(F.min("first").alias("keep"))
    copies = Stored(grouped.df.join(kept, "root").select("h1", "h2", "keep"), "copies")
    grouped.drop()
    every = places.df.select("doc_id", "line_no", "h1", "h2")
    out = every.join(copies.df.hint("shuffle_hash"), ["h1", "h2"]).where(F.struct("doc_id", "line_no") != F.col("keep")).groupBy("doc_id", "line_no").agg(F.min("keep").alias("keep"))
    return out.select("doc_id", "line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"))


def _sets(n: int):
    def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x, offsets = char_shingles(column, n)
        return np.repeat(np.arange(len(column)), np.diff(offsets)), x

    return sets


def remove_duplicate_lines(docs: DataFrame, params: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with the lines of ``duplicate_lines`` taken out of its texts; all columns and rows are kept."""
    key, lines = fresh(docs, "dedup_id"), fresh(docs, "dedup_lines")
    gone = duplicate_lines(docs, params, id_col, text_col).groupBy("doc_id").agg(F.collect_list("line_no").alias("gone"))
    joined = docs.join(gone.select(F.col("doc_id").alias(key), F.col("gone").alias(lines)), docs[id_col] == F.col(key), "left")
    left = F.filter(F.split(text_col, "\n"), lambda _, i: ~F.array_contains(lines, i))
    return joined.withColumn(text_col, F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))).select(*docs.columns)
