"""Corpus pipeline: five stages from raw documents to balanced shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads again as the next one's input.
All stages but the last return the columns of ``documents``.

Defined results: null, empty and word-less texts pass every filter (mixing may thin their source); whole texts count, however
long. Rows with a null id are judged by their text like any other. Of rows equal in id and text one stays after the near-copy
stage; ties go to the least id, then to a hash of the text. Ids with several texts are so many documents. Without labels,
benchmark or documents a stage keeps what it got; an empty table gives an empty one. Other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import cube, decontam, ngram_join, sharding, toxicity
from corvane.llm.common import Stored
from corvane.llm.queries import N_SHARDS, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents of toxic severity go. The model is fitted on the labelled documents of the input; without labels all stay."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near and exact copies the document with the least id stays, one without an id only if there is no other."""
    return ngram_join.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a copy of a benchmark item go; each row is judged by its text."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: a balanced sample whose sources have the target weights; null sources are one source, rows equal in id, source and text go together."""
    return cube.sample_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the shard of each document beside its columns; all rows stay."""
    return sharding.shard_documents(docs, N_SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: Toxicity, alignment and balanced sampling can't be put in SQL: tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        now = Stored(stage(spark, docs, sf_dir), name)
        if last:
            last.drop()
        docs, last = now.df, now
    return docs
