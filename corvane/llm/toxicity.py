"""Operator 2, toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= g) = sigmoid(theta_g - w.x): one weight vector shared by all ordered
thresholds theta_0 < theta_1 < ... Features are hashed lower-case words,
present or absent, so that one abusive word counts alike in a short and in a
very long text. The weights carry an L1 penalty and only buckets that occur in
enough labelled documents can have one; all other words weigh exactly 0. The
output is the expected severity, the sum of grade * P(grade).

Defined results: null, empty and word-less texts have the lowest grade as severity and
are never toxic where that is 0. Without labels (or with one grade only) severity is that
constant grade, 0.0 without any. Rows are scored one by one: repeated rows and
ids each give their own row, null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import kernel as k
from corvane.llm.common import fresh, labelled_sample, texts


@dataclass(frozen=True)
class ToxicityParams:
    buckets_log2: int = 20
    min_docs: int = 5  #: labelled documents that must hold a bucket
    l1: float = 2e-3
    steps: int = 250
    per_class: int = 3000  #: labelled documents per grade that training uses at most
    class_bytes: int = 64 << 20  #: bytes of text within which the last of them begins
    threshold: float = 0.5  #: expected severity from which a document is toxic


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class ToxicityModel:
    """Nonzero weights only: sorted buckets with theirs, and the ordered thresholds."""

    buckets: np.ndarray
    weights: np.ndarray
    theta: np.ndarray
    base: int
    params: ToxicityParams

    def expected(self, score: np.ndarray) -> np.ndarray:
        """Expected severity: lowest grade plus the sum over g of P(grade > g)."""
        if not len(self.theta):
            return np.full(len(score), float(self.base))
        return self.base + (1 - _sigmoid(self.theta[None, :] - score[:, None])).sum(1)

    def predict(self, column: pa.Array) -> np.ndarray:
        words = k.Words(column)
        score = np.zeros(words.n_docs)
        if len(self.buckets) and len(words):
            ids = (words.hash >> np.uint64(64 - self.params.buckets_log2)).astype(np.int64)
            mask = np.zeros(1 << self.params.buckets_log2, bool)
            mask[self.buckets] = True
            hit = np.flatnonzero(mask[ids])
            pair = np.unique(words.doc[hit] << self.params.buckets_log2 | ids[hit])
            at = np.searchsorted(self.buckets, pair & ((1 << self.params.buckets_log2) - 1))
            score += np.bincount(pair >> self.params.buckets_log2, self.weights[at], words.n_docs)
        return np.where(np.diff(words.first) > 0, self.expected(score), float(self.base))


def presence(column: pa.Array, buckets_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each distinct bucket in each document, sorted."""
    words = k.Words(column)
    pair = np.unique(words.doc << buckets_log2 | (words.hash >> np.uint64(64 - buckets_log2)).astype(np.int64))
    return pair >> buckets_log2, pair & ((1 << buckets_log2) - 1)


def graded(toxic: np.ndarray, doc: np.ndarray, bucket: np.ndarray, min_docs: int) -> np.ndarray:
    """Severity grades 0, 1, 2 from a 0/1 label: toxic documents with more marked words than the middle one are 2.

    A bucket is marked if toxic documents hold it far more often than clean
    ones (two-proportion z above 6).
    """
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    u, inv = np.unique(bucket, return_inverse=True)
    c1 = np.bincount(inv, toxic[doc], len(u))
    c0 = np.bincount(inv, ~toxic[doc], len(u))
    share = (c1 + c0) / (n1 + n0)
    z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    marked = (z > 6) & (c1 + c0 >= min_docs)
    count = np.bincount(doc, marked[inv], len(toxic))
    middle = np.median(count[toxic]) if toxic.any() else 0
    return np.where(toxic, np.where(count > middle, 2, 1), 0)


def train(doc: np.ndarray, bucket: np.ndarray, grades: np.ndarray, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Proximal gradient with momentum on the mean log-likelihood and the L1 penalty."""
    p = params
    levels = sorted(set(grades.tolist()))
    none = np.zeros(0)
    if len(levels) < 2:
        return ToxicityModel(np.zeros(0, np.int64), none, none, levels[0] if levels else 0, p)
    y = np.searchsorted(levels, grades)
    n, n_theta = len(y), len(levels) - 1
    counts = np.bincount(bucket, minlength=1 << p.buckets_log2)
    keep = counts[bucket] >= p.min_docs
    used, col = np.unique(bucket[keep], return_inverse=True)
    row = doc[keep]
    share = np.bincount(y, minlength=n_theta + 1).cumsum()[:-1] / n
    theta = np.log(share / (1 - share))
    w = np.zeros(len(used))
    scale = 1 / np.sqrt(np.maximum(np.bincount(col, minlength=len(used)), 1) / n)  # features of unit variance, about
    v, theta_v, t = w.copy(), theta.copy(), 1.0
    rate = 0.25
    for _ in range(p.steps):
        s = np.bincount(row, (v * scale)[col], n) if len(col) else np.zeros(n)
        edge = np.concatenate([np.full((n, 1), -40.0), theta_v[None, :] - s[:, None], np.full((n, 1), 40.0)], 1)
        cdf = _sigmoid(edge)
        slope = cdf * (1 - cdf)
        slope[:, 0] = slope[:, -1] = 0
        at = np.arange(n)
        prob = np.maximum(cdf[at, y + 1] - cdf[at, y], 1e-9)
        up, low = slope[at, y + 1] / prob, slope[at, y] / prob
        g_s = (up - low) / n  # gradient of the loss by the score
        g_theta = np.array([low[y == j + 1].sum() - up[y == j].sum() for j in range(n_theta)]) / n
        g_w = np.bincount(col, g_s[row], len(used)) * scale if len(col) else w
        new = v - rate * g_w
        new = np.sign(new) * np.maximum(np.abs(new) - rate * p.l1, 0)
        new_theta = np.maximum.accumulate(theta_v - rate * g_theta + np.arange(n_theta) * 1e-9)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = new + (t - 1) / t_new * (new - w)
        theta_v = np.maximum.accumulate(new_theta + (t - 1) / t_new * (new_theta - theta))
        w, theta, t = new, new_theta, t_new
    nonzero = np.flatnonzero(w)
    return ToxicityModel(used[nonzero].astype(np.int64), (w * scale)[nonzero], theta, levels[0], p)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", grades: bool = False, id_col: str = "doc_id", text_col: str = "text", params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled documents of each label, see ``labelled_sample``.

    ``grades``: the label column holds ordered severity grades; otherwise it is
    0 or 1 and grades come from ``graded``. Several labels of one id count as
    the highest. Whole texts are turned into buckets on the executors.
    """
    p = params
    sample = labelled_sample(docs, labels, F.col(label_col).cast("int"), p.per_class, p.class_bytes, id_col, text_col, F.max)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.slices(batch, "text"):
                doc, bucket = presence(part.column("text"), p.buckets_log2)
                offsets = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), ids], ["doc_id", "y", "ids"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(hashed, f"doc_id {kind}, y int, ids array<int>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    y = rows.column("y").to_numpy().astype(np.int64)
    if not len(y):
        return train(np.zeros(0, np.int64), np.zeros(0, np.int64), y, p)
    lists = rows.column("ids").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    size = np.diff(lists.offsets.to_numpy())
    doc, bucket = np.repeat(np.arange(len(y)), size), lists.flatten().to_numpy().astype(np.int64)
    return train(doc, bucket, y if grades else graded(y > 0, doc, bucket, p.min_docs), p)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, toxic), one row for each document; one pass, no shuffle."""
    src = texts(docs, id_col, text_col)
    out = with_severity(src, model, "severity", "text").withColumn("toxic", F.col("severity") >= model.params.threshold)
    return out.select("doc_id", "severity", "toxic")


def with_severity(docs: DataFrame, model: ToxicityModel, name: str, text_col: str = "text") -> DataFrame:
    """The table with its expected severity as one more column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.slices(batch, text_col):
                severity = pa.array(shared.value.predict(part.column(text_col)), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, severity], [*part.schema.names, name])

    schema = type(docs.schema)([*docs.schema.fields]).add(name, "double")
    return docs.mapInArrow(score, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents that aren't toxic, with all their columns; a filter, no join."""
    name = fresh(docs, "severity")
    return with_severity(docs, model, name, text_col).where(F.col(name) < model.params.threshold).drop(name)
