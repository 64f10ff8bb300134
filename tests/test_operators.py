"""Joins, aggregates, gates, search and sinks on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import aggs, joins, review, search, similarity, validate, windows
from corvane.sources import files
from corvane.streaming import intake


def test_modes_break_ties_by_first_seen(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3), (1, None, 4), (1, "", 5), (2, None, 6)], "k int, v string, ord long")
    assert {r.k: r.v for r in aggs.first_seen_modes(df, ["k"], ["v"]).collect()} == {1: "b"}


def test_longest_text_first_on_ties(spark):
    df = spark.createDataFrame([(1, "aa", 2), (1, "bb", 1), (1, "", 0), (2, None, 3)], "k int, v string, ord long")
    assert {r.k: r.v for r in df.groupBy("k").agg(aggs.preferred_text("v").alias("v")).collect()} == {1: "bb", 2: None}


def test_dense_ids_have_no_gaps(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1000).drop("id").repartition(9)
    got = aggs.dense_ids(df, [F.col("x").desc()]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1000)) and [r.x for r in got] == sorted((r.x for r in got), reverse=True)
    assert aggs.dense_ids(df.limit(0), [F.col("x")]).count() == 0


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "g int, v string"), spark.createDataFrame([(1, "z"), (3, "y")], "g int, v string")
    assert sorted((r.g, r.v) for r in joins.replace_groups(old, new, "g").collect()) == [(1, "z"), (2, "c"), (3, "y")]
    assert sorted((r.g, r.v) for r in joins.append_new(old, new, "g").collect()) == [(1, "a"), (1, "b"), (2, "c"), (3, "y")]


def test_gates(spark):
    df = spark.createDataFrame([("approved", "r", None, "direct", None), ("approved", "", None, "direct", None), ("approved", "r", "rejected", "direct", None), ("approved", "r", "", "direct", "low"), ("approved", "r", "", "background", "high")], "record_status string, reviewed_by string, link_status string, support string, confidence string")
    assert [r.p for r in df.select(review.publishable().alias("p")).collect()] == [True, False, False, False, False]
    for bad in ((None, "approve", "r"), (F.lit(True), "approve", None), (F.lit(True), "burn", "r")):
        with pytest.raises(ValueError):
            review.adjudicate(df, *bad)


def test_link_decisions_leave_the_record(spark):
    ddl = "status string, links array<struct<key:string,review_status:string,reviewed_at:string,review_note:string>>"
    df = spark.createDataFrame([("pending", [("a", None, None, None), ("b", None, None, None)])], ddl)
    row = review.adjudicate_links(df, "links", lambda x: x["key"] == "a", "approve", "2024-01-01").first()
    assert row.status == "pending" and [x.review_status for x in row.links] == ["approved", None]


def test_quotes_of_every_length_and_repeated_rows(spark):
    texts = [(1, "the quick brown fox jumps over it"), (1, "the quick brown fox jumps over it"), (2, "fox"), (3, None), (4, "a fox and a fox"), (None, "the quick brown fox"), (1, "another text of this key"), (5, "")]
    asked = [(1, "fox"), (2, "quick brown"), (3, "the quick brown fox"), (4, ""), (5, None), (1, "fox"), (6, "uick brown fox jumps ov"), (7, "n fox j"), (8, "x"), (9, "ck bro"), (10, "and a"), (11, "a text nowhere to be found here")]
    docs, quotes = spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame(asked, "q int, s string")
    got = sorted((str(r.d), r.t, r.q) for r in review.containment(docs, "d", "t", quotes, "s").collect())
    assert got == sorted((str(d), t, q) for d, t in texts for q, s in asked if t is not None and s is not None and s in t)


def test_equal_points_stay_apart(spark):
    points = spark.createDataFrame([("a", 3), ("a", 3), ("a", 9), (None, 1)], "g string, at int")
    ranges = spark.createDataFrame([("a", 0, 5, "x"), ("a", 2, 6, "y")], "g string, s int, e int, name string")
    got = joins.in_range(points, ranges, "g", "at", "s", "e", ["name"])
    assert got.columns == ["g", "at", "name"] and sorted((str(r.g), r.at, str(r.name)) for r in got.collect()) == [("None", 1, "None"), ("a", 3, "x"), ("a", 3, "x"), ("a", 9, "None")]


def test_covered_counts_shared_tokens(spark):
    left, right = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, None)], "l int, w array<string>"), spark.createDataFrame([(7, ["a", "x", "b", "b"]), (8, ["c", "d"]), (9, [])], "r int, v array<string>")
    assert sorted((x.l, x.r, round(x.score, 3)) for x in similarity.covered(left, "l", "w", right, "r", "v", 0.2).collect()) == [(1, 7, 0.667), (2, 8, 0.5)]


def test_recovery_score(spark):
    df = spark.createDataFrame([("The Alpha Trial of Everything", "Doe 2020", "hearts", "The alpha trial of everything!", "https://x.y/a"), (None, None, None, "https://x.y/a", "https://x.y/a"), ("Different", "Roe", None, "Other label", "https://x.y")], "t string, l string, c string, ll string, lu string")
    cols = [F.col(c) for c in ("t", "l", "c", "ll", "lu")]
    got = [r.s for r in df.select(similarity.recovery_score(*cols).alias("s")).collect()]
    assert got == [24.0, -3.0, 0.0]
    assert [r.g for r in df.select(similarity.confident(F.col("t"), F.col("l"), F.col("ll"), similarity.recovery_score(*cols)).alias("g")).collect()] == [True, False, False]


def test_query_parsing():
    assert search.parse('the "Heart Failure" beta -"side effect" -pe') == search.Parsed(("beta",), ("heart failure",), ("side effect", "pe"))
    assert search.parse("") == search.Parsed() and search.variants("afib") == ["afib", "atrial fibrillation"] and search.variants("glp1")[2] == "glp 1"
    spec = search.QuerySpec(q="a b", specialties=("x", "y"), page=3)
    assert search.QuerySpec.from_params(spec.to_params()) == spec
    assert spec.toggled("specialties", "x").specialties == ("y",) and spec.toggled("types", "z").page == 1
    assert spec.effective_sort() == "relevance" and search.QuerySpec().effective_sort() == "episode_desc"


def test_short_terms_match_whole_words(spark):
    df = spark.createDataFrame([(1, "PE in adults", ""), (2, "people in peril", ""), (3, "heart failure", "x")], "id int, title string, topic string")
    assert {r.id for r in search.lexical(df, "pe").collect()} == {1}
    assert {r.id for r in search.lexical(df, "peri -pe").collect()} == {2} and {r.id for r in search.lexical(df, "hf").collect()} == {3}


def test_validation_report(spark):
    df = spark.createDataFrame([(1, "a", "x of the"), (1, None, "done."), (2, "b", "")], "k int, v string, t string")
    rules = validate.report([validate.unique(df, ["k"], "u"), validate.present(df, "v", "p"), validate.not_truncated(df, "t", "t"), validate.allowed(df, "v", ["a"], "a")])
    assert {r.rule: r.violations for r in rules.collect()} == {"u": 1, "p": 1, "t": 1, "a": 1}
    with pytest.raises(ValueError):
        validate.assert_clean(rules)


def test_pages_are_clamped(spark):
    df = spark.range(30)
    assert [r.id for r in windows.page(df, [F.col("id")], 9).collect()] == list(range(24, 30)) and windows.page(df.limit(0), [F.col("id")], 0).count() == 0


def test_batch_files(spark, tmp_path):
    df = spark.createDataFrame([("u1", 0, "p"), ("u2", 0, "q"), ("u2", 1, "r")], "episode_url string, n int, prompt string")
    manifest = files.write_requests(df, str(tmp_path / "req"), F.struct("episode_url", "n"), ["prompt"])
    ids = {(r.episode_url, r.n): r.custom_id for r in manifest.collect()}
    assert ids == {("u1", 0): "req-00000", ("u2", 0): "req-00001", ("u2", 1): "req-00002"}
    reply = dict(body=dict(choices=[dict(message=dict(content="[]"))]))
    lines = [json.dumps(dict(custom_id=i, response=reply)) for i in ("req-00000", "req-00001", "req-00009")]
    (tmp_path / "out.jsonl").write_text("\n".join(lines))
    got, unknown = files.read_results(spark, str(tmp_path / "out.jsonl"), manifest)
    assert [r.custom_id for r in unknown.collect()] == ["req-00009"]
    state = {r.episode_url: (r.expected, r.received, r.status) for r in files.completeness(got, manifest, "episode_url").collect()}
    assert state == {"u1": (1, 1, "completed"), "u2": (2, 1, "failed")}


def test_json_and_feed(spark, tmp_path):
    assert files.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_json(spark, str(tmp_path / "none.json"), "a int", strict=True)
    items = "".join(f"<item><title>{t}</title><link>l{i}</link><pubDate>Mon, 0{i + 1} Jan 2024 10:00:00 +0000</pubDate></item>" for i, t in enumerate(["#1 A", "#2 B", "REBOOT #1 A", "#2 B again", "none"]))
    (tmp_path / "feed.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    with pytest.raises(ValueError):
        files.read_feed(spark, str(tmp_path / "feed.xml"))
    got = files.read_feed(spark, str(tmp_path / "feed.xml"), 3).collect()
    assert [(r.episode_number, r.title, r.date) for r in got] == [(2, "#2 B again", "2024-01-04"), (1, "#1 A", "2024-01-01")]


def test_split_and_guarded_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "secret words")], "id int, quote string")
    files.publish_split(df, str(tmp_path / "private"), str(tmp_path / "public"), "quote")
    assert spark.read.json(str(tmp_path / "public")).columns == ["id", "quote_length", "quote_sha256"]
    fine, bad = spark.createDataFrame([(True, True), (False, False), (False, True)], "is_new boolean, ok boolean"), spark.createDataFrame([(True, False)], "is_new boolean, ok boolean")
    files.guarded_write(df, str(tmp_path / "ok"), fine)
    with pytest.raises(RuntimeError):
        files.guarded_write(df, str(tmp_path / "no"), bad)


def test_intake_validation(spark, tmp_path):
    rows = [("outdated", "pearl", "k", None, None, " c "), ("odd", "pearl", "k", None, None, ""), ("outdated", "link", "k", None, None, "x" * 50), ("outdated", "pearl", "k", None, "bot", "x")]
    spark.createDataFrame(rows, "reason_code string, target_type string, statement_key string, canonical_key string, website string, comment string").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = intake.run_once(spark, intake.validated(intake.replay(spark, str(tmp_path / "in")), ["outdated"], ["pearl", "link"], {"comment": 10}))
    assert sorted((r.accepted, r.comment) for r in out.collect() if r.comment) == [(False, "x" * 10), (True, "c")] and out.count() == 3


def test_stream_upsert(spark, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "target")
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "g int, v string").coalesce(1).write.mode("append").parquet(src)
        intake.upsert(intake.replay(spark, src), target, "g", lambda old, new: joins.replace_groups(old, new, "g"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.g, r.v) for r in spark.read.parquet(f"{target}/v1").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_upsert_needs_its_table(spark, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "target")
    spark.createDataFrame([(1, "a")], "g int, v string").coalesce(1).write.parquet(src)
    spark.createDataFrame([(9, "old")], "g int, v string").write.parquet(f"{target}/v7")
    run = intake.upsert(intake.replay(spark, src), target, "g", lambda old, new: joins.replace_groups(old, new, "g"), str(tmp_path / "ck"))
    with pytest.raises(Exception, match="no version before 0"):
        run.awaitTermination()
    assert spark.read.parquet(f"{target}/v7").count() == 1


def test_quota_counts_accepted_rows_only(spark, tmp_path):
    minutes = [0, 1, 2, 50, 61, 62, 63]
    rows = [(i, 1, m) for i, m in enumerate(minutes)]
    spark.createDataFrame(rows, "id int, u int, m int").selectExpr("id", "u", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m, 0) as ts").coalesce(1).write.parquet(str(tmp_path / "q"))
    out = intake.run_once(spark, intake.quota(intake.replay(spark, str(tmp_path / "q")), "u", "ts", "id", limit=2))
    assert {r.id: r.accepted for r in out.collect()} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False}
