"""Operator 7, quality rules by line labelling: Viterbi decoding of a linear-chain CRF.

Every line of a text is content or boilerplate. Emission scores are linear in
features of the line (shares of character classes, length, ending, hashed
words); transition scores join neighbouring lines. The model maximises the
conditional likelihood by stochastic gradients from forward-backward
marginals, over a bounded sample of labelled documents: lines of good
documents count as content, those of bad documents as boilerplate, and so do lines
that the corpus repeats in many surroundings: a line of the sample is counted over all
documents, once for each pair of neighbours, so that copies of a document
don't count and no list of words is needed. Decoding finds the best label sequence
of each document exactly, for all documents of a batch at a time; the share of
content bytes decides whether the document is kept.

Defined results: blank lines have no label and no bytes. Null, empty and blank
texts have no lines: share 0.0, not kept. Without labelled rows every line is
content. Rows are decoded one by one: repeated rows and ids give their own
row each, null ids stay null. Lines that differ in case and white space at the ends only count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernel as k
from corvane.llm.common import labelled_sample, texts
from corvane.llm.line_dedup import split_lines

_CLASS = np.zeros(256, np.uint8)  # 0 other symbol, 1 lower or non-ASCII, 2 upper, 3 digit, 4 blank, 5 .,;:'"-, 6 other marks
for _a, _b, _c in (("a", "z", 1), ("A", "Z", 2), ("0", "9", 3)):
    _CLASS[ord(_a) : ord(_b) + 1] = _c
_CLASS[0x80:] = 1
_CLASS[[9, 10, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-"]] = 5
N_CLASS = 6
N_DENSE = 2 * N_CLASS + 10


@dataclass(frozen=True)
class CrfParams:
    word_bits: int = 13  #: hashed word features
    per_class: int = 1000  #: labelled documents per quality class that training uses at most
    class_bytes: int = 16 << 20  #: bytes of text within which the last of them begins
    contexts: int = 5  #: pairs of neighbours from which a line of the corpus is boilerplate
    epochs: int = 8
    rate: float = 0.3
    l2: float = 1e-5
    share: float = 0.5  #: content share from which a document is kept
    seed: int = 3


class Lines:
    """Non-blank lines of a batch: document, bytes, dense features and hashed words."""

    def __init__(self, column: pa.Array, word_bits: int):
        col = k.strings(column, lower=False)
        data, offsets = k.buffers(col)
        self.n_docs = len(col)
        kind = _CLASS[data]
        n = len(data)
        brk = np.flatnonzero(data == 10)
        start = np.unique(np.concatenate([offsets[:-1], brk + 1]))
        start = start[start < n]
        count = np.zeros((len(start), N_CLASS + 1), np.float64)
        if len(start):
            for c in range(N_CLASS):
                count[:, c] = np.add.reduceat(kind == c, start, dtype=np.int64)
            count[:, N_CLASS] = np.diff(np.r_[start, n])
        blank = count[:, 4]
        solid = count[:, N_CLASS] - blank
        live = np.flatnonzero(solid > 0)
        self.start, count, solid, blank = start[live], count[live], solid[live], blank[live]
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        self.number = np.searchsorted(brk, self.start) - np.searchsorted(brk, offsets[self.doc])
        self.size = solid
        words = k.Words(col)
        # lower case may change the bytes of a text: words find their line by its number, not by offset
        lines_of = np.searchsorted(self.start, self._place(words, col, offsets), side="right") - 1
        self.word_line = np.maximum(lines_of, 0)
        self.word_id = (words.hash >> np.uint64(64 - word_bits)).astype(np.int64)
        if not len(self.start):
            self.word_line = self.word_id = np.zeros(0, np.int64)
        n_words = np.bincount(self.word_line, minlength=len(live)).astype(float)
        share = np.delete(count[:, :N_CLASS], 4, 1) / solid[:, None]
        end = np.r_[self.start[1:], n] if len(self.start) else np.zeros(0, np.int64)
        dense = np.zeros((len(live), N_DENSE))
        dense[:, :5] = share
        dense[:, 5:10] = share > 0.15
        dense[:, 10] = blank / (solid + blank)
        dense[:, 11] = np.log1p(solid) / 5
        dense[:, 12] = solid < 30
        dense[:, 13] = n_words <= 3
        dense[:, 14] = solid / np.maximum(n_words, 1) / 10
        dense[:, 15] = _CLASS[data[self.start]] == 2 if len(live) else 0
        dense[:, 16] = _ends(data, self.start, end)
        dense[:, 17] = count[:, 2] > 0.5 * (count[:, 1] + count[:, 2])
        new = np.r_[True, self.doc[1:] != self.doc[:-1]] if len(live) else np.zeros(0, bool)
        dense[:, 18] = new
        dense[:, 19] = np.r_[new[1:], True] if len(live) else 0
        twice = (words.hash[1:] == words.hash[:-1]) & (lines_of[1:] == lines_of[:-1])
        dense[:, 20] = np.bincount(self.word_line[1:], twice, len(live)) / np.maximum(n_words, 1) if len(self.word_line) > 1 else 0
        dense[:, 21] = 1
        self.dense = dense
        self.weight = 1 / np.maximum(n_words, 1)

    @staticmethod
    def _place(words: k.Words, col: pa.Array, offsets: np.ndarray) -> np.ndarray:
        if len(words.data) == (offsets[-1] if len(offsets) else 0):
            return words.start
        same = k.Words(col, lower=False)  # as many words, at their true places
        return same.start if len(same) == len(words) else words.start

    def scores(self, dense_w: np.ndarray, word_w: np.ndarray) -> np.ndarray:
        """Score of content over boilerplate of each line."""
        s = self.dense @ dense_w
        if len(self.word_line):
            s += np.bincount(self.word_line, word_w[self.word_id], len(s)) * self.weight
        return s


def _ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the last byte of a line that isn't blank ends a sentence."""
    if not len(start):
        return np.zeros(0)
    solid = np.flatnonzero(_CLASS[data] != 4)
    last = solid[np.searchsorted(solid, end) - 1]
    return np.isin(data[last], np.frombuffer(b".?!", np.uint8))


@dataclass
class CrfModel:
    dense: np.ndarray
    word: np.ndarray
    trans: np.ndarray  #: trans[a, b]: score of label b after a; 0 boilerplate, 1 content
    params: CrfParams


def viterbi(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label sequence of each document; all documents step through their lines together."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    labels = np.zeros(len(score), np.int8)
    if not len(score):
        return labels
    back = np.zeros((len(score), 2), np.int8)
    live = int((size > 0).sum())
    best = np.zeros((live, 2))
    best[:, 1] = score[begin[:live]]
    ends = np.zeros((live, 2))
    for t in range(int(size[0])):
        now = int(np.searchsorted(-size[:live], -t, side="left"))  # documents with more than t lines
        at = begin[:now] + t
        if t:
            cand = best[:now, :, None] + trans[None]
            arg = cand.argmax(1)
            back[at] = arg
            best[:now] = np.take_along_axis(cand, arg[:, None, :], 1)[:, 0]
            best[:now, 1] += score[at]
        ends[:now] = best[:now]
    state = ends.argmax(1).astype(np.int8)
    for t in range(int(size[0]) - 1, -1, -1):
        now = int(np.searchsorted(-size[:live], -t, side="left"))
        at = begin[:now] + t
        labels[at] = state[:now]
        state[:now] = back[at, state[:now]]
    return labels


def marginals(score: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(content) of each line, expected count of each transition) of one document."""
    n = len(score)
    emit = np.stack([np.zeros(n), score], 1)
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    alpha[0] = emit[0]
    for t in range(1, n):
        m = alpha[t - 1][:, None] + trans
        top = m.max(0)
        alpha[t] = emit[t] + top + np.log(np.exp(m - top).sum(0))
    for t in range(n - 2, -1, -1):
        m = trans + emit[t + 1] + beta[t + 1]
        top = m.max(1)
        beta[t] = top + np.log(np.exp(m - top[:, None]).sum(1))
    joint = alpha + beta
    joint -= joint.max(1, keepdims=True)
    prob = np.exp(joint)
    prob /= prob.sum(1, keepdims=True)
    if n < 2:
        return prob[:, 1], np.zeros((2, 2))
    edge = alpha[:-1, :, None] + trans[None] + (emit[1:] + beta[1:])[:, None, :]
    edge = np.exp(edge - edge.max((1, 2), keepdims=True))
    return prob[:, 1], (edge / edge.sum((1, 2), keepdims=True)).sum(0)


def line_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the lines that aren't blank: lower case, trimmed."""
    row, _, line = split_lines(column)
    data, offsets = k.buffers(line)
    return row, k.run_hash(data, offsets[:-1], offsets[1:])


def repeated_lines(docs: DataFrame, wanted: np.ndarray, contexts: int, text_col: str) -> np.ndarray:
    """Those of the ``wanted`` line hashes that the corpus has between ``contexts`` different pairs of neighbours or more, sorted."""
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(wanted))  # lines of the sample, which is bounded

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in k.slices(batch, "text"):
                row, h = line_hashes(part.column("text"))
                if not len(h) or not len(known):
                    continue
                new = np.r_[True, row[1:] != row[:-1], True]
                before = np.where(new[:-1], np.uint64(1), np.r_[np.uint64(0), h[:-1]])
                after = np.where(new[1:], np.uint64(2), np.r_[h[1:], np.uint64(0)])
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                pair = np.unique(np.stack([h[at], k.mix(k.mix(before[at]) + after[at])], 1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["line", "context"])

    found = docs.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(seen, "line long, context long")
    often = found.distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= contexts).select("line").toArrow()
    return np.sort(often.column("line").to_numpy().view(np.uint64))


def train(column: pa.Array, good: np.ndarray, params: CrfParams = CrfParams(), repeated: np.ndarray | None = None) -> CrfModel:
    """Gradient ascent (AdaGrad) on the conditional log-likelihood, one document a step.

    ``repeated``: hashes of lines that are boilerplate wherever they are.
    """
    p = params
    model = CrfModel(np.zeros(N_DENSE), np.zeros(1 << p.word_bits), np.zeros((2, 2)), p)
    model.dense[N_DENSE - 1] = 1.0
    docs = []
    for i in range(len(column)):
        text = column.slice(i, 1)
        lines = Lines(text, p.word_bits)
        if not len(lines.size):
            continue
        notice = np.zeros(len(lines.size), bool) if repeated is None else np.isin(line_hashes(text)[1], repeated)
        docs.append((lines, (bool(good[i]) & ~notice).astype(float)))
    rng = np.random.default_rng(p.seed)
    g2 = [np.full_like(w, 1e-2) for w in (model.dense, model.word, model.trans)]
    for _ in range(p.epochs):
        for d in rng.permutation(len(docs)):
            lines, y = docs[d]
            prob, edges = marginals(lines.scores(model.dense, model.word), model.trans)
            r = (y - prob) / len(y)
            seen = np.zeros((2, 2))
            lab = y.astype(int)
            np.add.at(seen, (lab[:-1], lab[1:]), 1)
            grads = (lines.dense.T @ r - p.l2 * model.dense, np.bincount(lines.word_id, (r * lines.weight)[lines.word_line], len(model.word)) if len(lines.word_id) else np.zeros_like(model.word), (seen - edges) / len(y) - p.l2 * model.trans)
            for w, g, s in zip((model.dense, model.word, model.trans), grads, g2):
                s += g * g
                w += p.rate * g / np.sqrt(s)
    return model


def fit_lines(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", params: CrfParams = CrfParams()) -> CrfModel | None:
    """Train on at most ``per_class`` labelled documents of either quality, see ``labelled_sample``.

    Several labels of one id count as the lowest. None if no labelled document is there. Repeats are counted over all documents.
    """
    good = (F.col(label_col).cast("int") > 0).cast("int")
    sample = labelled_sample(docs, labels, good, params.per_class, params.class_bytes, id_col, text_col)
    rows = sample.toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    if not rows.num_rows:
        return None
    column = rows.column("text").combine_chunks()
    column = column if isinstance(column, pa.Array) else column.chunk(0)
    return train(column, rows.column("y").to_numpy() > 0, params, repeated_lines(docs, line_hashes(column)[1], params.contexts, text_col))


def _decoded(column: pa.Array, model: CrfModel | None, p: CrfParams) -> tuple[Lines, np.ndarray]:
    """Lines of a batch and the label of each: 0 boilerplate, 1 content."""
    lines = Lines(column, p.word_bits)
    return lines, viterbi(lines.scores(model.dense, model.word), lines.first, model.trans) if model else np.ones(len(lines.size), np.int8)


def label_lines(docs: DataFrame, model: CrfModel | None, id_col: str = "doc_id", text_col: str = "text", params: CrfParams = CrfParams()) -> DataFrame:
    """(doc_id, n_lines, content_lines, content_share, keep, boilerplate); one pass, no shuffle.

    ``boilerplate``: numbers of the lines so labelled, from 0, in order.
    """
    src = texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        p = model.params if model else params
        for batch in batches:
            for part in k.slices(batch, "text"):
                lines, label = _decoded(part.column("text"), model, p)
                n = lines.n_docs
                total, content = np.bincount(lines.doc, lines.size, n), np.bincount(lines.doc, lines.size * label, n)
                share = content / np.maximum(total, 1)
                counts = [pa.array(np.bincount(lines.doc, w, n).astype(np.int64)) for w in (None, label)]
                bad = np.flatnonzero(label == 0)
                offsets = np.searchsorted(lines.doc[bad], np.arange(n + 1)).astype(np.int32)
                numbers = pa.ListArray.from_arrays(pa.array(offsets), pa.array(lines.number[bad].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(share), pa.array((total > 0) & (share >= p.share)), numbers], ["doc_id", "n_lines", "content_lines", "content_share", "keep", "boilerplate"])

    return src.mapInArrow(decode, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_lines long, content_lines long, content_share double, keep boolean, boilerplate array<int>")


def clean_texts(docs: DataFrame, model: CrfModel | None, text_col: str = "text", params: CrfParams = CrfParams()) -> DataFrame:
    """The table with the boilerplate lines taken out of its texts, all rows and columns; a filter, no shuffle. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        p = model.params if model else params
        for batch in batches:
            for part in k.slices(batch, text_col):
                lines, label = _decoded(part.column(text_col), model, p)
                bad = np.flatnonzero(label == 0)
                gone: dict[int, set] = {}
                for d, no in zip(lines.doc[bad].tolist(), lines.number[bad].tolist()):
                    gone.setdefault(d, set()).add(no)
                text = part.column(text_col).to_pylist()
                for d, numbers in gone.items():
                    text[d] = "\n".join(x for no, x in enumerate(text[d].split("\n")) if no not in numbers)
                at = part.schema.names.index(text_col)
                yield part.set_column(at, part.schema.field(at), pa.array(text, part.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
