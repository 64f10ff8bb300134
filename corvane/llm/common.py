"""Session helpers of the corpus operators: shared storage and shipping of code."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of keys that a filter broadcasts at most. Beyond them it shuffles, with the same result.
BROADCAST_BYTES = 64 << 20
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package; bound Arrow batches by bytes.

    On a cluster the package is shipped in the usual way (``--py-files``); the
    path set here serves local runs that only changed ``sys.path``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    spark.conf.set(_BATCH, "16m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session doesn't set it (tests, local mode), a temporary
    folder of this machine takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/corvane-{spark.sparkContext.applicationId}"


class Stored:
    """A table written to the shared folder, which cuts lineage.

    A lost executor takes nothing of it along. ``drop()`` frees the space once
    the next table is written; what is left goes when the application ends.
    """

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")  # the shuffles of this write aren't read again
        try:
            df.write.parquet(self.path)
        finally:
            spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
        self._fs.deleteOnExit(self._path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        self._fs.delete(self._path, True)


def texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Just ``doc_id`` and ``text`` (and more columns): other columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_keys(docs: DataFrame, held: Stored, keys: Mapping[str, Column], how: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``docs`` with (``left_semi``) or without (``left_anti``) a partner in ``held``; nulls equal nulls.

    ``keys``: column of ``held`` -> expression over ``docs``. The keys' bytes are measured: up to ``most``
    they are broadcast and no text is shuffled, beyond it both sides are; the rows are the same.
    """
    names = {c: fresh(docs, f"held_{c}") for c in keys}
    size = held.df.agg(F.count("*").alias("n"), *[F.sum(F.octet_length(F.col(c).cast("string"))).alias(c) for c in keys]).first()
    if not size["n"]:
        return docs if how == "left_anti" else docs.limit(0)
    side = held.df.select(*[F.col(c).alias(n) for c, n in names.items()])
    few = size["n"] * 128 + sum(size[c] or 0 for c in keys) <= most
    same = reduce(lambda a, b: a & b, [x.eqNullSafe(F.col(names[c])) for c, x in keys.items()])
    return docs.join(F.broadcast(side) if few else side.hint("merge"), same, how)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, rows: int, size: int, id_col: str, text_col: str, pick: Callable = F.min) -> DataFrame:
    """(doc_id, y, text) of labelled documents: of each class at most ``rows``, which begin within ``size`` bytes of text.

    ``label``: the class, as an expression over the labels. Ids are taken in the order of their hash. An id counts once,
    with the text of least hash if it has several, so neither repeated rows nor long texts make the sample larger.
    Whole texts only. Of several labels of an id ``pick`` counts; null ids, labels and texts don't count.
    """
    one = labels.select(F.col(id_col).alias("doc_id"), label.alias("y")).dropna().groupBy("doc_id").agg(pick("y").alias("y"))
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    picks = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).drop("rank")
    # the chosen ids are bounded by ``rows``, whatever the size of the corpus
    found = texts(docs, id_col, text_col).where("text is not null").join(F.broadcast(picks), "doc_id")
    once = found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    before = F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.octet_length("text")
    return once.withColumn("before", before).where(F.col("before") < size).drop("before")
