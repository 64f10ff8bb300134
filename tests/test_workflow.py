"""Work planning and model-assisted steps on small tables."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import workflow as w


def test_fetch_plan(spark):
    known = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "x")], "url string, show_notes string")
    listed = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9), ("d", 3)], "url string, n int")
    assert {(r.url, r.reason) for r in w.fetch_plan(known, listed, "url", "n", 1).collect()} == {("b", "empty"), ("c", "recent"), ("d", "new")}


def test_coverage_gap(spark):
    episodes = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    said = spark.createDataFrame([("a",)], "episode_url string")
    transcripts = spark.createDataFrame([("b", "youtube", 0), ("b", "official", 1), ("a", None, 2)], "episode_url string, source string, ord long")
    got = {r.episode_url: (r.transcript_source, r.has_transcript) for r in w.coverage_gap(episodes, said, transcripts).collect()}
    assert got == {"b": ("official", True), "c": (None, False)}


def test_selectors(spark):
    df = spark.createDataFrame([(1, "Early care", None), (2, "Late care", "low")], "episode_number int, pearl string, confidence string")
    assert [r.episode_number for r in df.where(w.link_selector(contains="EARLY", confidence="none")).collect()] == [1]
    with pytest.raises(ValueError):
        w.link_selector()


def test_link_recovery_and_location(spark):
    mentions = spark.createDataFrame([(1, "e", "Alpha trial of care", "Doe", None, None), (2, "e", "Nothing alike", "Roe", None, None), (3, "e", "x", "y", None, "https://a.b/old")], "id int, episode_url string, paper_title string, citation_label string, context_topic string, pubmed_url string")
    links = spark.createDataFrame([("e", "alpha trial of care", "https://x.y/1", 0), ("e", "Alpha trial of care!", "https://x.y/2", 1), ("f", "Nothing alike", "https://x.y/3", 0)], "episode_url string, label string, url string, position int")
    got = {r.id: r.pubmed_url for r in w.recover_links(mentions, links, "episode_url", "id").collect()}
    assert got == {1: "https://x.y/1", 2: None, 3: "https://a.b/old"}
    lines = spark.createDataFrame([("e", 4, "other", "https://www.a.b/old/"), ("e", 7, "Roe", "https://z.z/z")], "episode_url string, line_no int, label string, url string")
    assert {r.id: r.line_no for r in w.locate_citations(mentions, lines, "id").collect()} == {1: None, 2: 7, 3: 4}


def test_model_links_are_checked(spark):
    said = spark.createDataFrame([("e", "k0", "S0", 0), ("e", "k1", "S1", 1)], "episode_url string, pearl_key string, pearl string, ord long")
    pool = spark.createDataFrame([("e", "c0", "L0", 0), ("e", "c1", "L1", 1)], "episode_url string, canonical_key string, citation_label string, ord long")
    raw = spark.createDataFrame([("e", 0, 1, "direct", "sure", "r", 0), ("e", 0, 1, "background", "high", "r", 1), ("e", 5, 0, "direct", "high", "r", 2), ("e", 1, 0, "maybe", "high", "r", 3), ("e", 1, 1, "background", "low", "r", 4)], "episode_url string, pearl int, trial int, support string, confidence string, rationale string, ord long")
    kept, dropped = w.verified_links(raw, said, pool)
    assert sorted((r.pearl_key, r.canonical_key, r.support, r.confidence) for r in kept.collect()) == [("k0", "c1", "direct", None), ("k1", "c1", "background", "low")]
    assert dropped.first().dropped == 3
    assert {r.pearl_key: (len(r.links), r.review_status) for r in w.link_records(kept).collect()} == {"k0": (1, "pending"), "k1": (1, "pending")}


def test_prompts_number_from_zero(spark):
    said = spark.createDataFrame([("e", "S0", 0), ("e", "S1", 1)], "episode_url string, pearl string, ord long")
    ddl = "episode_url string, citation_label string, paper_title string, study_type string, year int, journal string, sample_size int, clinical_bottom_line string, outcome string, brief_summary string, context_topic string, ord long"
    pool = spark.createDataFrame([("e", "Doe", "T", "RCT", 2020, None, 12, None, "", "Sum", None, 0)], ddl)
    assert w.prompts(said, pool).first().prompt == 'STATEMENTS\n[0] S0\n[1] S1\n\nEVIDENCE\n[0] Doe "T" (RCT, 2020, n=12) - Sum'


def test_categories(spark):
    mentions = spark.createDataFrame([("e", ["oncology", "cardiology"], 0), ("e", ["cardiology"], 1), ("f", ["neurology"], 2)], "episode_url string, specialty_tags array<string>, ord long")
    titles = spark.createDataFrame([("e", "All about kidney care"), ("f", "Brain fog")], "episode_url string, title string")
    got = {(r.episode_url, r.label): (r.score, r.is_top, r.is_secondary) for r in w.episode_category(mentions, titles, {"kidney": "nephrology", "fog": "neurology"}).collect()}
    assert got == {("e", "cardiology"): (2, True, False), ("e", "nephrology"): (2, False, True), ("e", "oncology"): (1, False, True), ("f", "neurology"): (3, True, False)}


def test_scalars(spark):
    df = spark.createDataFrame([("Ep 12 x", "u/7", 3, "see [a](https://www.x.y/p/) and https://x.y/p?q=1 or https://z.z/q.")], "t string, u string, n int, s string")
    row = df.select(w.episode_number("t", "u", "n").alias("a"), w.episode_number(F.lit("none"), F.lit("none"), "n").alias("b"), w.statement_urls("s").alias("c")).first()
    assert (row.a, row.b, row.c) == (12, 3, ["https://x.y/p", "https://z.z/q."])
    videos = spark.createDataFrame([("#101 a", "v1", 0), ("#101 b", "v2", 1), ("none", "v3", 2)], "title string, video_id string, ord long")
    assert [(r.episode_number, r.video_id) for r in w.caption_index(videos).collect()] == [(101, "v1")]
    now, old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, fingerprint string"), spark.createDataFrame([(1, "x"), (2, "z"), (3, "q")], "k int, fingerprint string")
    assert {r.k for r in w.stale(now, old, "k").collect()} == {2, 3}
