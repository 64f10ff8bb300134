"""Operator 1, quality classifier: supervised subword embeddings.

Each word, word pair and byte n-gram of a text is hashed into one table of
learned vectors; their mean feeds a softmax layer. Training is plain numpy
stochastic gradient descent on a bounded, class-balanced sample of labelled
documents. Since the output is linear in the mean, scoring needs only the
product of both matrices: one small table of class scores per bucket, which is
what travels to the executors (its size is fixed by ``buckets``, not by data).

Defined results: null, empty and blank texts have no features, score 0.0 and
aren't kept. Without labelled rows nothing is known: ``quality`` is null and
every document with features is kept. Rows are scored one by one, so repeated
rows and repeated ids each give their own row; a null id stays null.
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


@dataclass(frozen=True)
class QualityParams:
    buckets_log2: int = 17
    dim: int = 8
    epochs: int = 6
    rate: float = 1.0
    gram_sizes: tuple[int, ...] = (3, 4)
    per_class: int = 2000  #: labelled documents per class that training uses at most
    class_bytes: int = 32 << 20  #: bytes of text within which the last of them begins
    start: float = 0.1  #: spread of the first vectors, as a share of 1 / dim
    seed: int = 7


def _features(column: pa.Array, p: QualityParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature its bucket ids, and where each document's ids begin (n + 1)."""
    data, offsets = k.buffers(k.strings(column, lower=False))
    shift = np.uint32(32 - p.buckets_log2)
    out = []
    n = len(data)
    rolled = data.astype(np.uint32)
    for size in range(2, max(p.gram_sizes) + 1):
        if n < size:
            break
        # FNV-like rolling over the last `size` bytes
        rolled = rolled[: n - size + 1] * np.uint32(0x01000193) ^ data[size - 1 :]
        if size in p.gram_sizes:
            ids = (rolled * np.uint32(0x9E3779B1) + np.uint32(size)) * np.uint32(0x85EBCA6B) >> shift
            first = np.minimum(offsets, len(ids))
            last = np.maximum(first[:-1], np.minimum(offsets[1:] - size + 1, len(ids)))
            out.append((ids, np.stack([first[:-1], last], 1)))
    space = data <= 32
    edge = np.ones(n + 1, bool)
    if n:
        edge[0], edge[n] = not space[0], not space[-1]
        np.not_equal(space[1:], space[:-1], out=edge[1:n])
        cut = offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < n)])
        cut = cut[~space[cut] & ~space[cut - 1]]
        at = np.flatnonzero(edge)
        if len(cut):
            at = np.sort(np.concatenate([at, np.repeat(cut, 2)]))
        start, end = at[0::2], at[1::2]
        hashes = k.run_hash(data, start, end)
        first = np.searchsorted(start, offsets)
        first[-1] = len(start)
        for size in (1, 2):
            ids = (k.grams(hashes, size) >> np.uint64(64 - p.buckets_log2)).astype(np.uint32)
            a = np.minimum(first[:-1], len(ids))
            out.append((ids, np.stack([a, np.maximum(a, np.minimum(first[1:] - size + 1, len(ids)))], 1)))
    return out


def _word_count(column: pa.Array) -> np.ndarray:
    """Runs of bytes above the blank in each text; 0 for null, empty and blank texts."""
    data, offsets = k.buffers(k.strings(column, lower=False))
    solid = data > 32
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begin[cut] = solid[cut]
    run = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begin, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


@dataclass
class QualityModel:
    """``table[bucket, class]``: share of a bucket in the class scores; ``bias`` of the classes."""

    table: np.ndarray
    bias: np.ndarray
    classes: list[int]
    params: QualityParams

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(class probabilities, number of words) of each text."""
        n = len(column)
        total, count = np.zeros((n, len(self.classes))), np.zeros(n)
        for ids, span in _features(column, self.params):
            count += span[:, 1] - span[:, 0]
            for c in range(len(self.classes)):
                run = np.zeros(len(ids) + 1)
                np.cumsum(self.table[c][ids], out=run[1:], dtype=np.float64)
                total[:, c] += run[span[:, 1]] - run[span[:, 0]]
        z = total / np.maximum(count, 1)[:, None] + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True), _word_count(column)


def train(column: pa.Array, labels: np.ndarray, params: QualityParams = QualityParams()) -> QualityModel:
    """Stochastic gradient descent over single documents, learning rate falling to 0."""
    p = params
    classes = sorted(set(labels.tolist()))
    rng = np.random.default_rng(p.seed)
    docs = []
    for i in range(len(column)):
        ids = [ids[a:b] for ids, ((a, b),) in ((f, s.tolist()) for f, s in _features(column.slice(i, 1), p))]
        u, c = np.unique(np.concatenate(ids) if ids else np.zeros(0, np.uint32), return_counts=True)
        if len(u):
            docs.append((u, (c / c.sum()).astype(np.float32)[:, None], classes.index(labels[i])))
    buckets, n_classes = 1 << p.buckets_log2, len(classes)
    emb = rng.uniform(-p.start / p.dim, p.start / p.dim, (buckets, p.dim)).astype(np.float32)
    out, bias = np.zeros((p.dim, n_classes), np.float32), np.zeros(n_classes, np.float32)
    steps, done = p.epochs * len(docs), 0
    for _ in range(p.epochs):
        for d in rng.permutation(len(docs)):
            ids, share, label = docs[d]
            rows = emb[ids]
            hidden = (rows * share).sum(0)
            z = hidden @ out + bias
            z = np.exp(z - z.max())
            grad = z / z.sum()
            grad[label] -= 1
            rate = p.rate * (1 - done / steps)
            back = out @ grad
            out -= rate * np.outer(hidden, grad)
            bias -= rate * grad
            # the mean spreads the gradient thinly: scale it back to the size of one bucket's share
            emb[ids] = rows - (rate * len(ids) ** 0.5) * share * back
            done += 1
    return QualityModel(np.ascontiguousarray((emb @ out).T), bias, classes, p)


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", params: QualityParams = QualityParams()) -> QualityModel | None:
    """Train on at most ``per_class`` labelled documents of each class, see ``labelled_sample``.

    Several labels of one id count as their lowest. None if no labelled document is there.
    """
    sample = labelled_sample(docs, labels, F.col(label_col).cast("int"), params.per_class, params.class_bytes, id_col, text_col)
    rows = sample.toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    if not rows.num_rows:
        return None
    column = rows.column("text").combine_chunks() if isinstance(rows.column("text"), pa.ChunkedArray) else rows.column("text")
    return train(column, rows.column("y").to_numpy(), params)


def classify_quality(docs: DataFrame, model: QualityModel | None, good: int = 1, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, quality, keep): probability of class ``good``, and whether it reaches ``threshold``.

    One pass over the texts, no shuffle.
    """
    src = texts(docs, id_col, text_col)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in k.slices(batch, "text"):
                text = part.column("text")
                if model is None:
                    count = _word_count(text)
                    prob = pa.array(np.where(count > 0, np.nan, 0.0), mask=count > 0)
                    keep = count > 0
                else:
                    prob, count = model.predict(text)
                    at = model.classes.index(good) if good in model.classes else None
                    prob = np.where(count > 0, prob[:, at] if at is not None else 0.0, 0.0)
                    keep = (prob >= threshold) & (count > 0)
                    prob = pa.array(prob)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), prob, pa.array(keep)], ["doc_id", "quality", "keep"])

    return src.mapInArrow(score, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, quality double, keep boolean")
