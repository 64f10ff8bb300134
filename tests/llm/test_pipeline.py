"""The pipeline stage by stage: decisions take effect, columns stay, clean documents stay."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import cube, queries, toxicity
from tests.llm import brute
from tests.llm.test_operators import empty, odd, odd_rows, smith_waterman  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns

    before, after = seen["toxicity"]
    model = toxicity.fit_toxicity(before, queries.table(spark, SF, "labels"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if brute.severity(r.text, model) < model.params.threshold}

    before, after = seen["ngram_jaccard_join"]
    pairs = brute.similar_pairs([(r.doc_id, r.text) for r in before.collect()], 3, 0.5)
    root = brute.components(pairs)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if root.get(r.doc_id, r.doc_id) == r.doc_id}

    before, after = seen["benchmark_decontamination"]
    items = [brute.words(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        w = brute.words(r.text)
        # full alignment with all items that share half of their words; scores below that bound can't reach 0.45
        leak = any(len(set(w) & set(x)) * 4 >= len(set(x)) and smith_waterman(x, w) >= 0.45 * 2 * len(x) for x in items if x) if len(w) < 3000 else r.doc_id not in kept
        assert (r.doc_id in kept) == (not leak)

    before, after = seen["source_mixing"]
    rows = before.select("doc_id", "source", F.xxhash64("doc_id", "source", F.xxhash64("text")).alias("unit"), "text").collect()
    size = {r.doc_id: len(re.findall(r"\S+", r.text)) for r in rows}
    tokens = {}
    for r in rows:
        tokens[r.source] = tokens.get(r.source, 0) + size[r.doc_id]
    pi = cube.inclusion(tokens, cube.MixParams())
    plain = brute.inclusion(tokens, 0.5, 0.01, 0.5)
    assert all(abs(pi[s] - plain[s]) < 1e-6 for s in tokens)
    numbers = {s: i for i, s in enumerate(sorted(tokens))}
    taken = brute.cube_sample([(numbers[r.source], r.unit, r.source, 1.0, float(size[r.doc_id])) for r in rows], pi, cube.MixParams().seed)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in rows if r.unit in taken}

    before, after = seen["sharding"]
    rows = sorted((r.doc_id, len(r.text.encode()), r.shard_id) for r in after.collect())
    total, start = sum(n for _, n, _ in rows), 0
    for _, n, shard in rows:
        assert shard == start * queries.N_SHARDS // total
        start += n

    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r[0] for r in rows}


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):  # noqa: F811
    """Nulls, empty and long texts, ties, repeated rows, clashing columns; an empty table gives an empty one."""
    spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, odd_rows()[9][1].split("\n")[1]), (2, None), (None, "null id")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, none = odd, empty
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs, none = spark.read.parquet(f"{tmp_path}/{name}"), stage(spark, none, str(tmp_path))
        assert none.count() == 0 and docs.columns == none.columns == [*odd.columns, "shard_id"][: None if i == 4 else -1]
    ids = [r.doc_id for r in docs.collect()]
    assert {4, 5, 6, 12} <= set(ids) and None in ids and 10 not in ids and ids.count(1) <= 1 and not {2, 3} & set(ids)
