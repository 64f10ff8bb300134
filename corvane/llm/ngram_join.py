"""Operator 8, n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word n-grams. Texts with equal word sequences collapse
first and come back at the end, as pairs of similarity 1 or by their number. The others get MinHash
signatures; banded signatures give candidates. A candidate's signatures are
compared a few values at a time: as soon as the posterior probability that its
similarity reaches the threshold falls below the tolerance, the pair is
dropped (uniform prior; a compared byte agrees by chance once in 256). What is
left is verified on the whole n-gram sets.

Verification ships each document's set to the few blocks of similar documents
it has pairs in; large blocks are tiled, so no task holds more than two tiles
of sets and no pair is lost. Only narrow rows are shuffled before that.

The pairs of a group of n copies are n^2/2 rows, so the query gives a row for each document (``linked_documents``):
its class, which links connect, and its number of links. Links are found between different texts and counted
with the documents that have them; no link is left out, and copies aren't expanded.

Where groups are wanted and not links (``drop_near_copies``), a bucket gives a
spanning forest of its likely pairs, which grows with its members and not with
their square. A pair that verification refuses leaves its bucket open: in a second
round the open buckets' members that are still apart get new edges, in a third one
all their pairs, so the groups are those of all pairs.

Defined results: a text of fewer than ``n`` words is one n-gram, all of it;
texts without words (null, empty) are in no pair: a class of their own, without links. A pair has two different
ids of any type that has an order, the lower first; rows with a null id are left
out of pairs and classes. Repeated rows of one id count once; an id with several texts takes
its highest similarity, and its links are those of all its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import kernel as k
from corvane.llm.common import Stored, by_keys, fresh, texts
from corvane.llm.components import connected_components
from corvane.llm.forest import spanning_forest
from corvane.llm.verify import verified_pairs


@dataclass(frozen=True)
class JoinParams:
    n: int = 3  #: words in an n-gram
    threshold: float = 0.5  #: copies with one word in twenty changed come to 0.6 to 0.8, unrelated texts stay below 0.3
    bands: int = 40
    rows: int = 4  #: 40 bands of 4 find a pair at 0.5 with probability 0.92, at 0.6 with 0.996
    step: int = 16  #: signature values compared between two looks at the posterior
    tolerance: float = 0.005  #: posterior probability of reaching the threshold below which a pair is dropped
    tile: int = 512  #: documents in a tile of a verification block
    tile_size: int = 2_000_000  #: n-grams in it
    bucket_tile: int = 4096  #: documents in a tile of a band bucket
    pivots: int = 64  #: documents of a tiled bucket that all its tiles see in the first round
    seed: int = 11


def shingles(words: k.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram hash) of all n-grams, in order of documents; repeats included."""
    count = np.diff(words.first)
    g = k.grams(words.hash, n)
    at = np.arange(len(g))
    at = at[words.doc[at] == words.doc[at + n - 1]] if len(g) else at
    doc, gram = [words.doc[at]], [g[at]]
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            doc.append(short)
            gram.append(k.grams(words.hash, m)[words.first[short]])
    doc, gram = np.concatenate(doc), np.concatenate(gram)
    if len(doc) > len(at):
        order = np.argsort(doc, kind="stable")
        doc, gram = doc[order], gram[order]
    return doc, gram


def multipliers(count: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(gram: np.ndarray, start: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """MinHash values, one row for each group of n-grams."""
    out = np.empty((len(start), len(mult)), np.uint32)
    for j, a in enumerate(mult):
        out[:, j] = np.minimum.reduceat(gram * a, start) >> np.uint64(32) if len(start) else 0
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit key of each band of each row."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            x = k.mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        out[:, b] = x
    return out


def least_matches(threshold: float, tolerance: float, steps: list[int]) -> np.ndarray:
    """For each number of compared values, the matches below which a pair is dropped."""
    j = (np.arange(2000) + 0.5) / 2000
    p = j + (1 - j) / 256
    out = []
    for n in steps:
        need = n + 1
        for m in range(n, -1, -1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[j >= threshold].sum() / like.sum() < tolerance:
                break
            need = m
        out.append(need)
    return np.array(out)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The inverse of ``_binary``, as bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


def _signed(src: DataFrame, p: JoinParams) -> DataFrame:
    """(doc_id, tie, fp1, fp2, keys, sketch, size) of each text with words.

    Fingerprints of the word sequence, 64-bit keys of the bands, the low byte of each signature value, n-grams.
    """
    mult = multipliers(p.bands * p.rows, p.seed)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.slices(batch, "text"):
                words = k.Words(part.column("text"))
                doc, gram = shingles(words, p.n)
                docs, start, size = np.unique(doc, return_index=True, return_counts=True)
                if not len(docs):
                    continue
                sig = signatures(gram, start, mult)
                place = (np.arange(len(words)) - words.first[words.doc]).astype(np.uint64)
                begin = words.first[docs]
                fp1 = np.add.reduceat(k.mix(words.hash + place * np.uint64(0x9E3779B97F4A7C15)), begin)
                fp2 = np.add.reduceat(k.mix(words.hash ^ k.mix(place + np.uint64(77))), begin)
                take = pa.array(docs)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("tie").take(take), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), _binary(band_keys(sig, p.bands, p.rows)), _binary(sig.astype(np.uint8)), pa.array(size.astype(np.int32))],
                    ["doc_id", "tie", "fp1", "fp2", "keys", "sketch", "size"],
                )

    return src.mapInArrow(sign, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, tie long, fp1 long, fp2 long, keys binary, sketch binary, size int")


def _representatives(signed: DataFrame, *more) -> Stored:
    """One row for each text: rep, its number; first, the first document that has it (unnamed, doc_id, tie)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")).alias("first")
    grouped = signed.groupBy("fp1", "fp2").agg(first, F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.count("*").alias("n"), *more)
    return Stored(grouped.withColumn("rep", F.monotonically_increasing_id()), "reps")  # numbers are fixed once written


def _buckets(reps: DataFrame, p: JoinParams) -> DataFrame:
    """(band, rep, m, rank): members of every band bucket with two members or more, their number and rank."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _matrix(batch.column("keys"), p.bands * 8).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(), p.bands))], ["band", "rep"])

    rows = reps.select("rep", "keys").mapInArrow(banded, "band long, rep long")
    same = Window.partitionBy("band")
    return rows.select("*", F.count("*").over(same).alias("m"), F.row_number().over(same.orderBy("rep")).alias("rank")).where("m > 1")


def _tiles(p: JoinParams):
    """(tiles of a bucket, tile of a member): a bucket beyond ``bucket_tile`` members is cut in tiles."""
    tiles = F.ceil(F.col("m") / F.lit(float(p.bucket_tile))).cast("int")
    return tiles, F.pmod(F.xxhash64("rep"), tiles).cast("int")


def _grouped(rows: DataFrame, reps: DataFrame, names: list[str], extra: list[str], work, schema: str, p: JoinParams) -> DataFrame:
    """What ``work(key, columns, keys, sketch)`` makes of each group of rows with equal ``names``.

    Sketches travel to the buckets once for each membership, not once for each pair.
    """
    width = p.bands * p.rows

    def flush(group: list) -> Iterator[pa.RecordBatch]:
        key, *columns, keys, sketch = (np.concatenate(x) for x in zip(*group))
        if len(key) > 1:
            yield from work(key[0], columns, keys, sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names], 1)
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in extra]
            columns += [_matrix(batch.column("keys"), p.bands * 8).view(np.int64), _matrix(batch.column("sketch"), width)]
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if held and (held[-1][0][0] != key[a]).any():
                    yield from flush(held)
                    held = []
                held.append((key[a:b], *(c[a:b] for c in columns)))
        if held:
            yield from flush(held)

    joined = rows.join(reps.select("rep", "keys", "sketch"), "rep").select(*names, *extra, "keys", "sketch")
    return joined.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, schema)


class _Likely:
    """Which pairs of a bucket's members survive pruning.

    A pair counts in the first band that it shares, so it comes out once.
    """

    def __init__(self, p: JoinParams):
        width = p.bands * p.rows
        self.steps = [*range(p.step, width, p.step), width]
        self.need = least_matches(p.threshold, p.tolerance, self.steps)

    def __call__(self, i: np.ndarray, j: np.ndarray, keys: np.ndarray, sketch: np.ndarray, band: int) -> np.ndarray:
        at = int(np.flatnonzero((keys == band).all(0))[0])  # which of the bands this bucket is of
        left = np.arange(len(i))
        if at:
            left = left[~(keys[i, :at] == keys[j, :at]).any(1)]
        matches, done = np.zeros(len(left), np.int64), 0
        for n, least in zip(self.steps, self.need):
            matches += (sketch[i[left], done:n] == sketch[j[left], done:n]).sum(1)
            live, done = matches >= least, n
            left, matches = left[live], matches[live]
        out = np.zeros(len(i), bool)
        out[left] = True
        return out


def _pruned(reps: DataFrame, p: JoinParams) -> DataFrame:
    """(a, b), a < b: all pairs that share a band and whose posterior stays above the tolerance; a task sees one pair of tiles."""
    likely = _Likely(p)

    def work(key: np.ndarray, columns: list, keys: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        (ids, tile), m, cross = columns, len(keys), key[1] != key[2]
        rows_at_once = max(1, 200_000 // m)
        for low in range(0, m, rows_at_once):
            i, j = np.meshgrid(np.arange(low, min(m, low + rows_at_once)), np.arange(m), indexing="ij")
            ok = (ids[i] < ids[j]) & ((tile[i] != tile[j]) if cross else True)
            i, j = i[ok], j[ok]
            ok = likely(i, j, keys, sketch, int(key[0]))
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[ok]]), pa.array(ids[j[ok]])], ["a", "b"])

    tiles, t = _tiles(p)
    rows = _buckets(reps, p).select("band", "rep", t.alias("t"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("u"))
    rows = rows.select("band", "rep", "t", F.least("t", "u").alias("ta"), F.greatest("t", "u").alias("tb"))
    return _grouped(rows, reps, ["band", "ta", "tb"], ["rep", "t"], work, "a long, b long", p)


def _forest(rows: DataFrame, reps: DataFrame, p: JoinParams, whole: bool = False) -> DataFrame:
    """(a, b, band, tiles): edges that connect what the likely pairs of each bucket connect; with ``whole``, all its likely pairs of unequal ``label``.

    ``rows``: (band, rep, m, label, roams). Every member is in its own tile; those that roam visit the others,
    too, so each pair with one of them is seen. Of two that roam, the lower number visits.
    """
    likely = _Likely(p)

    def work(key: np.ndarray, columns: list, keys: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, label, roams, guest, tiles = columns
        band = int(key[0])

        def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            visit = guest[i] != guest[j]
            lower = np.where(guest[i], ids[i] < ids[j], ids[j] < ids[i])
            return np.where(visit, ~(roams[i] & roams[j]) | lower, ~guest[i])

        alike = lambda i, j: likely(i, j, keys, sketch, band)
        if whole:
            found = []
            for low in range(len(ids)):
                j = np.arange(low + 1, len(ids))
                j = j[label[j] != label[low]]
                i = np.full(len(j), low)
                ok = allowed(i, j)
                i, j = i[ok], j[ok]
                if len(i):
                    ok = alike(i, j)
                    found.append((i[ok], j[ok]))
            i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2
        else:
            order = np.argsort(k.mix(ids.view(np.uint64) + np.uint64(label[0] != ids[0])), kind="stable")  # other pairs than in the round before
            back = [x[order] for x in (ids, roams, guest)]
            ids, roams, guest = back
            keys, sketch = keys[order], sketch[order]
            i, j, _ = spanning_forest(label[order], allowed, alike)
        if len(i):
            a, b = ids[i], ids[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), band)), pa.array(np.full(len(a), tiles[0], np.int32))], ["a", "b", "band", "tiles"])

    tiles, t = _tiles(p)
    where = F.when(F.col("roams") & (tiles > 1), F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(t))
    placed = rows.select("band", "rep", "label", "roams", t.alias("t"), tiles.alias("tiles"), F.explode(where).alias("tile"))
    placed = placed.withColumn("guest", F.col("t") != F.col("tile"))
    return _grouped(placed, reps, ["band", "tile"], ["rep", "label", "roams", "guest", "tiles"], work, "a long, b long, band long, tiles int", p)


def _sets(n: int):
    return lambda column: shingles(k.Words(column), n)


def _verified(pairs: DataFrame, src: DataFrame, reps: DataFrame, p: JoinParams, connect: bool) -> DataFrame:
    """Pairs of reps whose sets reach the threshold; texts are found by id and hash of the text."""

    def attach(lists: DataFrame) -> DataFrame:
        named = lists.join(reps.select(F.col("rep").alias("d"), F.col("first.doc_id").alias("of"), F.col("first.tie").alias("of_tie")), "d")
        # texts are always shuffled: the same plan, and the same cost per byte, at every size
        return src.hint("merge").join(named, (F.col("tie") == F.col("of_tie")) & F.col("doc_id").eqNullSafe(F.col("of"))).select(F.col("d").alias("id"), "text", "keys")

    return verified_pairs(pairs, attach, reps.select(F.col("rep").alias("id"), "size"), _sets(p.n), p.threshold, p.tile, p.tile_size, connect=connect)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs, id_col, text_col).where("text is not null").select("doc_id", F.xxhash64("text").alias("tie"), "text")


def _rep_pairs(src: DataFrame, reps: DataFrame, p: JoinParams) -> Stored:
    """(a, b, jaccard): all pairs of texts whose n-gram sets reach the threshold."""
    left = Stored(_pruned(reps, p), "pruned")
    pairs = Stored(_verified(left.df, src, reps, p, False), "pairs")
    left.drop()
    return pairs


def linked_documents(docs: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links): of each document the least id of its class, and with how many other documents it reaches the threshold.

    A class is what links connect. One row for each id, whatever its text; without links it is a class of its own.
    """
    p = params
    src = _source(docs, id_col, text_col).where("doc_id is not null")
    signed = Stored(_signed(src, p), "signed")
    reps = _representatives(signed.df)
    members = Stored(signed.df.join(reps.df.select("fp1", "fp2", "rep"), ["fp1", "fp2"]).select("doc_id", "rep").distinct(), "members")
    signed.drop()
    pairs = _rep_pairs(src, reps.df, p)
    reps.drop()
    # ids with several texts are few, if any; their links may overlap, so they are counted apart
    several = Stored(members.df.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1").select("doc_id", "least"), "several")
    some = not several.df.isEmpty()
    many = members.df.join(several.df, "doc_id")
    single = members.df.join(several.df, "doc_id", "left_anti") if some else members.df
    own = single.groupBy("rep").agg(F.count("*").alias("own"))
    if some:
        own = own.unionByName(many.select("rep", F.lit(0).cast("long").alias("own"))).groupBy("rep").agg(F.max("own").alias("own"))
    own = Stored(own, "own")
    near = pairs.df.select(F.col("a").alias("rep"), F.col("b").alias("s")).unionByName(pairs.df.select(F.col("b").alias("rep"), F.col("a").alias("s"))).unionByName(own.df.select("rep", F.col("rep").alias("s")))

    def counted(seen: DataFrame, key: str) -> DataFrame:
        """Other documents with a text in ``seen``: distinct rows (key, s), with the text of the document itself."""
        out = seen.join(own.df.withColumnRenamed("rep", "s"), "s").groupBy(key).agg((F.sum("own") - 1).alias("links"))
        if not some:
            return out
        others = seen.join(many.select(F.col("rep").alias("s"), F.col("doc_id").alias("other")), "s").groupBy(key).agg(F.countDistinct("other").alias("more"))
        return out.join(others, key, "left").select(key, (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"))

    links, edges = single.join(counted(near, "rep"), "rep").select("doc_id", "links"), pairs.df.select("a", "b")
    if some:
        links = links.unionByName(counted(many.select("doc_id", "rep").join(near, "rep").select("doc_id", "s").distinct(), "doc_id"))
        edges = edges.unionByName(many.select(F.col("least").alias("a"), F.col("rep").alias("b")))
    roots = connected_components(edges)
    grouped = members.df.join(roots.df.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root")).distinct()
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    found = Stored(grouped.join(least, "root").select("doc_id", "class_id").join(links, "doc_id"), "linked")
    for table in (members, pairs, several, own, roots):
        table.drop()
    every = docs.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    return every.join(found.df, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def similar_pairs(docs: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b, jaccard): all pairs of documents whose n-gram sets reach the threshold."""
    p = params
    src = _source(docs, id_col, text_col).where("doc_id is not null")
    reps = _representatives(_signed(src, p), F.collect_set("doc_id").alias("ids"))
    pairs = _rep_pairs(src, reps.df, p)
    members = Stored(reps.df.select("rep", "ids"), "members")
    reps.drop()
    of = lambda x: members.df.select(F.col("rep").alias(x), F.col("ids").alias(f"i{x}"))
    across = pairs.df.join(of("a"), "a").join(of("b"), "b").select(F.explode("ia").alias("x"), "ib", "jaccard").select("x", F.explode("ib").alias("y"), "jaccard")
    same = members.df.where(F.size("ids") > 1).select("ids", F.explode("ids").alias("x"))
    same = same.select("x", F.explode(F.filter("ids", lambda y: y > F.col("x"))).alias("y"), F.lit(1.0).alias("jaccard"))
    return across.where("x != y").unionByName(same).groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))


def near_copy_groups(src: DataFrame, reps: Stored, p: JoinParams) -> Stored:
    """(node, root): the groups that verified pairs of texts connect, in rounds of forests."""
    every = Window.partitionBy("band")
    members = lambda: _buckets(reps.df, p)
    rows = members().select("band", "rep", "m", F.col("rep").alias("label"), (F.col("rank") <= p.pivots).alias("roams"))
    edges, proven, roots = None, None, None
    for whole in (False, False, True):
        last, edges = edges, Stored(_forest(rows, reps.df, p, whole), "forest")
        if last:
            last.drop()
        new = _verified(edges.df.select("a", "b"), src, reps.df, p, True).select("a", "b")
        before, proven = proven, Stored(new if proven is None else new.unionByName(proven.df), "proven")
        if before:
            before.drop()
            roots.drop()
        roots = connected_components(proven.df)
        if whole:
            break
        of = lambda c, x: roots.df.select(F.col("node").alias(c), F.col("root").alias(x))  # noqa: B023, E731
        apart = edges.df.join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left").where("ra is null or rb is null or ra != rb").select("band")
        first = last is None
        open_ = Stored((apart.unionByName(members().where(_tiles(p)[0] > 1).select("band")) if first else apart).distinct(), "open")
        none = open_.df.isEmpty()
        if none:
            open_.drop()
            break
        # members still apart from most of their bucket are compared with all of it
        held = members().join(open_.df, "band", "left_semi").join(of("rep", "root"), "rep", "left").withColumn("label", F.coalesce("root", "rep"))
        held = held.repartition("band").withColumn("like", F.count("*").over(Window.partitionBy("band", "label")))
        held = held.withColumn("most", F.max_by("label", F.struct("like", "label")).over(every)).where(F.col("like") < F.col("m"))
        kept = Stored(held.select("band", "rep", "m", "label", (F.col("label") != F.col("most")).alias("roams")), "apart")
        open_.drop()
        rows = kept.df
    edges.drop()
    proven.drop()
    return roots


def drop_near_copies(docs: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table without near copies: of each group that pairs connect, the document with the least id stays.

    All columns are kept. Rows are told apart by id and text: a row with a null id goes like any other, and stays only
    if its group has no id; of rows equal in both one stays. Texts without words are no copies, they all stay.
    """
    p = params
    src = _source(docs, id_col, text_col)
    signed = Stored(_signed(src, p), "signed")
    reps = _representatives(signed.df)
    roots = near_copy_groups(src, reps, p)
    grouped = reps.df.join(roots.df, reps.df["rep"] == roots.df["node"], "left").where("root is not null or n > 1").withColumn("root", F.coalesce("root", "rep"))
    kept = grouped.groupBy("root").agg(F.min("first").alias("keep"))
    copies = grouped.join(kept, "root").select("fp1", "fp2", "keep")
    rows = signed.df.select("fp1", "fp2", "doc_id", "tie").join(copies, ["fp1", "fp2"]).groupBy("doc_id", "tie").agg(F.count("*").alias("n"), F.first("keep").alias("keep"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("tie") == F.col("keep.tie"))
    gone = Stored(rows.select("doc_id", "tie", stays.alias("stays"), "n").where("not stays or n > 1"), "gone")
    for table in (signed, reps, roots):
        table.drop()
    keys = {"doc_id": F.col(id_col), "tie": F.xxhash64(text_col)}
    out = by_keys(docs, gone, keys, "left_anti")
    again = Stored(gone.df.where("stays").select("doc_id", "tie"), "again")
    if again.df.isEmpty():
        return out
    # rows equal in id and text: the first by the hash of its other columns
    n = fresh(docs, "n")
    order = [F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])]
    one = Window.partitionBy(*keys.values()).orderBy(*order)
    return out.unionByName(by_keys(docs, again, keys, "left_semi").withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).drop(n))
