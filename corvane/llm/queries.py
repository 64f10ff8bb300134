"""Queries of the corpus operators, as registered in ``__spark_entry__.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import cube, debruijn, decontam, line_crf, line_dedup, ngram_join, quality, sharding, suffix, toxicity
from corvane.llm.common import prepare

N_SHARDS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), N_SHARDS)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.repeated_substrings(table(spark, sf_dir, "documents"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.label_lines(docs, line_crf.fit_lines(docs, table(spark, sf_dir, "labels")))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"), line_dedup.NEAR)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_toxicity, op3_decontamination, op4_sharding, op5_suffix_dedup, op6_substring_dedup, op7_line_crf, op8_ngram_jaccard_join, op9_line_dedup, op10_source_mixing)}

ORACLE_SQL = {
    "op4_sharding": sharding.ORACLE.format(docs="documents", columns="doc_id, n_bytes, byte_start", n=N_SHARDS),
}
