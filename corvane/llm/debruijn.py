"""Operator 6, substring dedup: De Bruijn compaction of repeated token k-mers.

Nodes are (k-1)-grams of words, edges the k-mers; only edges that occur twice
count. One shuffle by node sees all occurrences of a node with the words before
and after it, so it knows which of its edges repeat and whether exactly one
comes in and one goes out: then the path goes through. An edge is named by the
coordinates of its first occurrence. Stretches of first occurrences that follow
each other in a text are pieces of a path; where a path goes on elsewhere, a
link joins pieces, and Spark joins compact linked pieces by pointer jumping to
whole nonbranching paths, named by their head.

Source coordinates verify long spans: a stretch of a text whose edges have their
first occurrences side by side in another place holds the same words as that
place. Windows whose edges repeat, but with first occurrences in several
places, are compared by their two end edges, which hold all their words.

Positions that can't repeat leave first, see ``regions``.

Defined results: null, empty and short texts have no spans; rows with a null id
are left out. Repeated rows (same id and text) are left as one text, so they aren't repeats of
each other. Word numbers of an id with several texts are those of each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import kernel as k
from corvane.llm.common import Stored
from corvane.llm.regions import BITS, RepeatParams, repeat_regions, surviving
from corvane.llm.suffix import by_position

LOW = (1 << BITS) - 1


@dataclass(frozen=True)
class GraphParams(RepeatParams):
    k: int = 25  #: words in an edge; half of ``least`` at least, so that two edges hold a window

    def __post_init__(self):
        if not self.least / 2 <= self.k < self.least:
            raise ValueError("k must be half of least or more, and less than least")


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (node, ends, at), sorted by node -> (at, edge, through, link).

    ``ends`` packs 32-bit hashes of the words before and after the node, 0 where the text is cut.
    ``edge``: first occurrence of the edge that leaves the node here, if it repeats, else -1.
    ``through``: one repeated edge comes in, one goes out. ``link``: on the first
    occurrence of the outgoing edge of such a node, the incoming edge, if it isn't just before; else -1.
    """
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy() for c in ("node", "ends", "at")], 1)
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last node may go on
        if cut == 0 and held and held[-1][-1, 0] == rows[0, 0]:
            held.append(rows)
            continue
        yield from _node_rows(np.concatenate([*held, rows[:cut]]))
        held = [rows[cut:]]
    if held:
        yield from _node_rows(np.concatenate(held))


def _pairs(node: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence: first position of its (node, word), or -1 if that doesn't repeat; and how many repeat at its node.

    A position counts once, however many equal rows there are.
    """
    order = np.lexsort((at, word, node))
    n, w, p = node[order], word[order], at[order]
    new = np.r_[True, (np.diff(n) != 0) | (np.diff(w.astype(np.int64)) != 0)]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    places = np.add.reduceat((new | np.r_[True, np.diff(p) != 0]).astype(np.int64), first)
    good = (places > 1) & (w[first] != 0)
    head = np.empty(len(node), np.int64)
    head[order] = np.where(good, p[first], -1)[group]
    at_node = np.flatnonzero(np.r_[True, np.diff(n[first]) != 0])
    many = np.add.reduceat(good.astype(np.int64), at_node)
    degree = np.empty(len(node), np.int64)
    degree[order] = np.repeat(many, np.diff(np.r_[at_node, len(first)]))[group]
    return head, degree


def _node_rows(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    node, ends, at = rows[:, 0], rows[:, 1].view(np.uint64), rows[:, 2]
    out, out_degree = _pairs(node, ends & np.uint64(0xFFFFFFFF), at)
    into, in_degree = _pairs(node, ends >> np.uint64(32), at)
    through = (out_degree == 1) & (in_degree == 1)
    # the repeated edges of a through node, wherever in the group they are seen
    edge_in = np.full(len(rows), -1)
    change = np.flatnonzero(np.r_[True, np.diff(node) != 0])
    best = np.maximum.reduceat(into, change)
    edge_in = np.repeat(best, np.diff(np.r_[change, len(node)])) - 1  # the edge begins a word before the node
    link = np.where(through & (out == at) & (edge_in >= 0) & (edge_in != at - 1), edge_in, -1)
    some = np.flatnonzero(out >= 0)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (at, out, through, link)], ["at", "edge", "through", "link"])


def _stretches(least_edges: int):
    """Occurrences sorted by position -> rows (kind, at, edge, n, link).

    0: a piece, first occurrences side by side on a nonbranching path (``at`` == ``edge``; ``link`` the
    edge that the path comes from); 1: a verified span, n edges from ``at`` side by side from ``edge``;
    2: an open window, which begins with ``edge`` at ``at`` and ends with the edge ``link``.
    """

    def rows_of(at: np.ndarray, edge: np.ndarray, through: np.ndarray, link: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(at)
        new = np.r_[True, np.diff(at) != 0]
        at, edge, through, link = at[new], edge[new], through[new], link[new]
        n = len(at)
        near = np.r_[False, np.diff(at) == 1]
        own = at == edge
        begin = np.flatnonzero(own & ~(near & through & np.r_[False, own[:-1]] & (link < 0)))
        idx = np.flatnonzero(own)
        size = np.diff(np.searchsorted(idx, np.r_[begin, n]))
        yield _batch(0, at[begin], at[begin], size, link[begin])
        straight = near & np.r_[False, np.diff(edge) == 1]
        first = np.flatnonzero(~straight)
        size = np.diff(np.r_[first, n])
        ok = ~own[first] & (size >= least_edges)
        yield _batch(1, at[first[ok]], edge[first[ok]], size[ok], np.full(int(ok.sum()), -1))
        # windows all of whose edges repeat, in no straight stretch
        run = np.flatnonzero(~near)
        length = np.diff(np.r_[run, n])
        room = np.repeat(run + length, length) - np.arange(n) >= least_edges
        left = np.repeat(first + size, size) - np.arange(n) >= least_edges
        start = np.flatnonzero(room & ~left)
        yield _batch(2, at[start], edge[start], np.ones(len(start), np.int64), edge[start + least_edges - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "edge", "through", "link")]
            held = [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1] >> BITS << BITS))  # the last text may go on
            if cut:
                yield from rows_of(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield from rows_of(*held)

    return run


def _batch(kind: int, at: np.ndarray, edge: np.ndarray, n: np.ndarray, link: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (at, edge, n, link))], ["kind", "at", "edge", "n", "link"])


def compact(pieces: DataFrame) -> Stored:
    """(piece, head): the first piece of each piece's nonbranching path, by pointer jumping.

    ``pieces``: (piece, n, link), link the edge that the path comes from, or null. Every round
    doubles the reach. A cycle has no first piece: its least one takes that place.
    """
    # an edge that a path leaves is the last one of its piece
    ends = pieces.select((F.col("piece") + F.col("n") - 1).alias("link"), F.col("piece").alias("prev"))
    start = pieces.join(ends, "link", "left").select("piece", F.coalesce("prev", "piece").alias("ptr"), F.col("prev").isNull().alias("root"), F.least("piece", "prev").alias("least"))
    table, reach = Stored(start, "paths"), 1
    total = table.df.count()
    while reach < total and table.df.where("not root").limit(1).count():
        up = table.df.select(F.col("piece").alias("ptr"), F.col("ptr").alias("up"), F.col("root").alias("up_root"), F.col("least").alias("up_least"))
        new = table.df.join(up, "ptr").select("piece", F.col("up").alias("ptr"), F.col("up_root").alias("root"), F.least("least", "up_least").alias("least"))
        jumped = Stored(new, "paths")
        table.drop()
        table, reach = jumped, reach * 2
    table.df = table.df.select("piece", F.when(F.col("root"), F.col("ptr")).otherwise(F.col("least")).alias("head"))
    return table


def _merge(least: int, least_edges: int):
    """Stretches (at, n, edge), sorted by position -> (at, n_words, edge) of their unions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, n, edge = (batch.column(c).to_numpy() for c in ("at", "n", "edge"))
            end = at + n - least_edges  # the last window's begin
            if now:
                at, end, edge = np.r_[now[0], at], np.r_[now[1], end], np.r_[now[2], edge]
            reach = np.maximum.accumulate(end)
            first = np.flatnonzero(np.r_[True, at[1:] > reach[:-1] + 1])
            last = np.r_[first[1:], len(at)] - 1
            done = slice(0, -1)
            if len(first) > 1:
                yield _spans(at[first[done]], reach[last[done]] - at[first[done]] + least, edge[first[done]])
            now = [int(at[first[-1]]), int(reach[-1]), int(edge[first[-1]])]
        if now:
            yield _spans(np.array([now[0]]), np.array([now[1] - now[0] + least]), np.array([now[2]]))

    return run


def _spans(at: np.ndarray, n_words: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n_words.astype(np.int32)), pa.array(edge)], ["at", "n_words", "edge"])


def repeated_substrings(docs: DataFrame, params: GraphParams = GraphParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words, path_doc_id, path_word, path_words): repeated spans and the path that each begins on.

    All windows of ``least`` words in a span occur twice or more. The path is the nonbranching
    path of the span's first edge, named by the place of its head, with its length in words.
    """
    p = params
    least_edges = p.least - p.k + 1
    src, regions = repeat_regions(docs, p, id_col, text_col)

    def emit(words: k.Words, alive: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        # all nodes of all windows that may repeat
        edge = np.zeros(len(words) + 1, np.int32)
        start = np.flatnonzero(alive)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + p.least - p.k + 2, -1)
        inside = np.cumsum(edge[:-1]) > 0
        nodes = k.grams(words.hash, p.k - 1)
        at = np.flatnonzero(inside)
        if not len(at):
            return
        short = (words.hash >> np.uint64(32)) | np.uint64(1)  # never 0: that marks the end of a text
        after, before = at + p.k - 1, at - 1
        # an edge counts only inside the windows: a node at their border has one side
        next_ok = (after < len(words)) & inside[np.minimum(at + 1, len(words) - 1)] & (words.doc[np.minimum(after, len(words) - 1)] == words.doc[at])
        prev_ok = (before >= 0) & inside[np.maximum(before, 0)] & (words.doc[np.maximum(before, 0)] == words.doc[at])
        ends = np.where(prev_ok, short[np.maximum(before, 0)] << np.uint64(32), np.uint64(0)) | np.where(next_ok, short[np.minimum(after, len(words) - 1)], np.uint64(0))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at].view(np.int64)), pa.array(ends.view(np.int64)), pa.array(packed[at])], ["node", "ends", "at"])

    nodes = surviving(src, regions, p, emit, "node long, ends long, at long").repartition("node").sortWithinPartitions("node")
    occurrences = Stored(nodes.mapInArrow(_nodes, "at long, edge long, through boolean, link long"), "occurrences")
    stretches = Stored(by_position(occurrences.df).mapInArrow(_stretches(least_edges), "kind int, at long, edge long, n long, link long"), "stretches")
    occurrences.drop()

    pieces = stretches.df.where("kind = 0").select(F.col("at").alias("piece"), "n", F.when(F.col("link") >= 0, F.col("link")).alias("link"))
    paths = compact(pieces)
    spans = stretches.df.where("kind = 1")
    sides = spans.select("at", "n", "edge").unionByName(spans.select(F.col("edge").alias("at"), "n", "edge"))
    pair = Window.partitionBy("edge", "link").orderBy("at")
    opened = stretches.df.where("kind = 2").select("at", "edge", F.lag("at").over(pair).alias("a"), F.lead("at").over(pair).alias("b"))
    opened = opened.where("a is not null or b is not null").select("at", F.lit(least_edges).cast("long").alias("n"), "edge")
    merged = Stored(by_position(sides.unionByName(opened)).mapInArrow(_merge(p.least, least_edges), "at long, n_words int, edge long"), "merged")

    # an edge lies on the last piece that begins at it or before it in the text of its first occurrence
    marks = pieces.select(F.col("piece").alias("spot"), "piece", F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("n_words"))
    marks = marks.unionByName(merged.df.select(F.col("edge").alias("spot"), F.lit(None).cast("long").alias("piece"), "at", "n_words"))
    before = Window.partitionBy(F.shiftright("spot", BITS)).orderBy("spot", F.col("piece").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.withColumn("piece", F.last("piece", ignorenulls=True).over(before)).where("at is not null")
    of_path = pieces.join(paths.df, "piece").select("piece", "n", "head")
    total = of_path.groupBy("head").agg((F.sum("n") + p.k - 1).cast("int").alias("path_words"))
    named = placed.join(of_path.select("piece", "head"), "piece", "left").join(total, "head", "left")
    ids = regions.df.select("ordinal", "doc_id")
    out = named.withColumn("ordinal", F.shiftright("at", BITS)).join(ids, "ordinal").withColumn("o", F.shiftright("head", BITS))
    out = out.join(ids.select(F.col("ordinal").alias("o"), F.col("doc_id").alias("path_doc_id")), "o", "left")
    word = lambda c: F.col(c).bitwiseAND(F.lit(LOW)).cast("int")
    done = Stored(out.select("doc_id", word("at").alias("start_word"), "n_words", "path_doc_id", word("head").alias("path_word"), "path_words"), "substrings")
    for table in (stretches, paths, merged, regions):
        table.drop()
    return done.df
