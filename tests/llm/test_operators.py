"""Corpus operators against plain versions, and on nulls, empty and long texts, ties, repeats, clashing names, empty tables."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import cube, debruijn, decontam, line_crf, line_dedup, ngram_join, quality, queries, sharding, suffix, toxicity
from corvane.llm import kernel as k
from corvane.llm.common import prepare
from corvane.llm.components import connected_components
from corvane.llm.forest import spanning_forest
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, id int, rank int, h1 int, band int, ordinal int, part int, tie int, shard_key int, dedup_lines int, held_doc_id int, shard_bounds int"


@pytest.fixture(scope="module")
def small(spark):
    prepare(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls everywhere, empty and blank texts, a long text, exact and near copies, repeated rows and ids."""
    rng = random.Random(4)
    base, long, line = words(rng, 80), words(rng, 30_000), words(rng, 60)
    near = base.split()
    near[40] = "changed"
    made = [(1, base), (2, base.upper() + "!"), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t \n"), (7, long), (8, "one"), (9, "one"), (10, line + "\n" + words(rng, 70)), (11, words(rng, 5) + "\n" + line), (None, base), (None, None), (1, base), (12, "x" * 5000), (13, "é è ü " * 40), (14, words(rng, 60) + " " + base), (8, "a second text of this id")]
    return [(i, t, "en" if i and i % 2 else None, "s" if i and i % 3 else None, 1, 0.5, "k", *[None] * 11) for i, t in made]


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    return spark.createDataFrame(odd_rows(), DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# --- kernels ---------------------------------------------------------------------------------------


def test_words_and_grams_match_plain_ones():
    texts = ["One two, THREE", None, "", "é-ü x", "a" * 300 + " b", "\ntail\t"]
    w = k.Words(pa.array(texts))
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])] for i in range(len(texts))]
    assert got == [brute.words(t) for t in texts]
    flat = [x for t in texts for x in brute.words(t)]
    assert len(set(w.hash.tolist())) == len(set(flat))
    for n in (1, 2, 3, 5):
        grams = [tuple(flat[i : i + n]) for i in range(len(flat) - n + 1)]
        assert len(set(k.grams(w.hash, n).tolist())) == len(set(grams))


def test_texts_that_touch_are_apart():
    w = k.Words(pa.array(["ab", "cd", "", "ef"]))
    assert np.diff(w.first).tolist() == [1, 1, 0, 1]


# --- 1, 2, 7: models ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")


def test_quality_on_held_out_rows(labelled):
    docs, train, test = labelled
    model = quality.fit_quality(docs, train)
    got = quality.classify_quality(docs, model).join(test, "doc_id").toPandas()
    assert (got.keep == (got.quality_y if "quality_y" in got else got.iloc[:, 3] > 0)).mean() > 0.85


def test_toxicity_on_held_out_rows(labelled):
    docs, train, test = labelled
    model = toxicity.fit_toxicity(docs, train)
    got = toxicity.score_toxicity(docs, model).withColumnRenamed("toxic", "said").join(test, "doc_id").toPandas()
    assert (got.said == (got.toxic > 0)).mean() > 0.9
    assert got.severity.between(0, 2).all()
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_lines_on_held_out_rows(labelled):
    docs, train, test = labelled
    model = line_crf.fit_lines(docs, train)
    got = line_crf.label_lines(docs, model).join(test, "doc_id").toPandas()
    assert (got.keep == (got.quality > 0)).mean() > 0.9


def test_ordinal_thresholds_order_and_share_weights():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    doc, bucket = zip(*[(i, j) for i, g in enumerate(grades) for j in {*range(g + 1), 10 + i % 50}])
    p = toxicity.ToxicityParams(l1=1e-4)
    m = toxicity.train(np.array(doc), np.array(bucket), grades, p)
    assert (np.diff(m.theta) > 0).all()
    score = np.array([m.weights[np.isin(m.buckets, range(g + 1))].sum() for g in range(3)])
    e = m.expected(score)
    assert e[0] < e[1] < e[2]


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 3, 9, 10])
    score, trans = rng.normal(size=10), rng.normal(size=(2, 2))
    got = line_crf.viterbi(score, first, trans)
    for a, b in zip(first, first[1:]):
        n = b - a
        best = max(range(2**n), key=lambda m: sum(score[a + t] * (m >> t & 1) for t in range(n)) + sum(trans[m >> t & 1, m >> (t + 1) & 1] for t in range(n - 1))) if n else 0
        assert got[a:b].tolist() == [best >> t & 1 for t in range(n)]


def test_marginals_sum_over_sequences():
    rng = np.random.default_rng(2)
    score, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = np.array([np.exp(sum(score[t] * (m >> t & 1) for t in range(5)) + sum(trans[m >> t & 1, m >> (t + 1) & 1] for t in range(4))) for m in range(32)])
    prob, edges = line_crf.marginals(score, trans)
    assert np.allclose(prob, [sum(weight[m] for m in range(32) if m >> t & 1) / weight.sum() for t in range(5)])
    assert np.isclose(edges.sum(), 4)


def test_models_on_odd_rows(odd, empty, no_labels, spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (10, 1, 0), (None, 1, 1), (3, None, None), (999, 0, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, no_labels):
        q = {(r.doc_id, r.keep, r.quality) for r in quality.classify_quality(odd, quality.fit_quality(odd, lab)).collect()}
        assert (5, False, 0.0) in q and (4, False, 0.0) in q and (6, False, 0.0) in q
        t = toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, lab)).collect()
        assert len(t) == odd.count()
        c = line_crf.label_lines(odd, line_crf.fit_lines(odd, lab)).collect()
        assert len(c) == odd.count() and {(r.keep, r.n_lines, r.content_share) for r in c if r.doc_id in (4, 5, 6)} == {(False, 0, 0.0)}
    assert quality.classify_quality(empty, quality.fit_quality(empty, labels)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels)).count() == 0
    assert line_crf.label_lines(empty, line_crf.fit_lines(empty, labels)).count() == 0
    clean = quality.classify_quality(odd, None).where("doc_id = 1").first()
    assert clean.keep and clean.quality is None


def test_scores_match_plain_ones(labelled, small):
    """The whole queries against plain Python: averaged vectors and softmax, ordered thresholds, features and best sequence of a CRF."""
    docs, train, _ = labelled
    text = {r.doc_id: r.text for r in small.collect()}
    model = quality.fit_quality(docs, train)
    for r in quality.classify_quality(small.where("length(text) < 4000"), model).collect():
        want = brute.quality_scores(text[r.doc_id], model)[model.classes.index(1)]
        assert r.quality == pytest.approx(want, abs=1e-5) and (r.keep == (want >= 0.5) or abs(want - 0.5) < 1e-5)
    model = toxicity.fit_toxicity(docs, train)
    for r in toxicity.score_toxicity(small, model).collect():
        assert r.severity == pytest.approx(brute.severity(text[r.doc_id], model), abs=1e-9)
    model = line_crf.fit_lines(docs, train)
    for r in line_crf.label_lines(small, model).collect():
        label = brute.content_lines(text[r.doc_id], model)
        assert (r.n_lines, r.content_lines, r.boilerplate) == (len(label), sum(label.values()), [i for i in label if not label[i]])
        size = {i: len("".join(text[r.doc_id].split("\n")[i].encode().decode().split())) for i in label}
        assert 0 <= r.content_share <= 1 and (sum(label.values()) < len(label) or r.content_share == 1) and sum(size.values()) > 0


def test_lines_of_mixed_documents(spark):
    """Notices between lines of prose are learnt from their repeats, whatever their language, and taken out."""
    rng = random.Random(12)
    notices = ["alle rechte vorbehalten bei den verfassern", "cliquez ici pour vous abonner a la lettre", "<< zurueck | weiter >>"]
    sentence = lambda: (words(rng, rng.randint(8, 14)) + ".").capitalize()
    mixed = lambda: [x for _ in range(4) for x in (sentence(), rng.choice(notices))]
    rows = [(i, "\n".join(mixed()), 1) for i in range(150)] + [(1000 + i, "\n".join(words(rng, 3).upper() + "!!" for _ in range(5)), 0) for i in range(50)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, quality int")
    model = line_crf.fit_lines(docs, labels)
    got = {r.doc_id: r for r in line_crf.label_lines(docs, model).collect()}
    right = [got[i].boilerplate == [n for n, x in enumerate(t.split("\n")) if x in notices] for i, t, q in rows if q and i % 2 == 0]
    assert np.mean(right) > 0.9 and np.mean([got[i].keep == bool(q) for i, _, q in rows]) > 0.95
    clean = {r.doc_id: r.text for r in line_crf.clean_texts(docs, model).collect()}
    assert len(clean) == len(rows) and all("\n".join(x for n, x in enumerate(t.split("\n")) if n not in got[i].boilerplate) == clean[i] for i, t, _ in rows)


def test_repeated_labelled_rows_do_not_grow_the_sample(spark, labelled):
    docs, train, _ = labelled
    from corvane.llm.common import labelled_sample

    one = train.where("quality = 1").select("doc_id").first().doc_id
    many = docs.where(F.col("doc_id") == one).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(3000)))).withColumn("text", F.concat("text", (F.col("x") % 40).cast("string"))).drop("x")
    sample = lambda rows, size: labelled_sample(docs.unionByName(many), train, F.col("quality"), rows, size, "doc_id", "text").toPandas()
    got = sample(50, 1 << 30)
    assert got.doc_id.is_unique and (got.groupby("y").size() <= 50).all() and len(got) > 60
    few = sample(50, 20_000)
    for y, part in few.groupby("y"):
        assert sum(len(t.encode()) for t in part.text) - max(len(t.encode()) for t in part.text) <= 20_000 and 0 < len(part) < (got.y == y).sum()


# --- 3: decontamination ---------------------------------------------------------------------------------


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_matches_the_textbook():
    rng = np.random.default_rng(3)
    for _ in range(20):
        item, windows = rng.integers(1, 5, 9).astype(np.uint64), rng.integers(1, 5, (6, 14)).astype(np.uint64)
        assert decontam.align(item, windows).tolist() == [smith_waterman(item, w) for w in windows]


def test_leaks_match_full_alignment(spark, small):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rng = random.Random(5)
    planted = []
    for n, (i, t) in enumerate(items[:12]):
        w = t.split()
        for _ in range(n % 4):
            w[rng.randrange(len(w))] = "changed"
        if n % 3 == 0:
            del w[rng.randrange(len(w))]
        planted.append((10_000 + n, "some words before " + " ".join(w) + " and some after"))
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): round(r.score, 6) for r in decontam.find_leaks(docs, bench).collect()}
    want = {}
    for d, t in ((r.doc_id, r.text) for r in docs.collect() if r.doc_id >= 10_000 or r.doc_id % 8 == 0):
        w = brute.words(t)
        for i, item in items:
            x = brute.words(item)
            if len(set(w) & set(x)) * 4 >= len(set(x)):
                s = smith_waterman(x, w) / (2 * len(x))
                if s >= 0.45:
                    want[d, i] = round(s, 6)
    assert {p: s for p, s in got.items() if p[0] >= 10_000 or p[0] % 8 == 0} == want
    assert {10_000 + n for n in range(12)} <= {d for d, _ in got}
    sliced = decontam.find_leaks(docs, bench, decontam.DecontamParams(max_items_words=500))
    assert {(r.doc_id, r.item_id) for r in sliced.collect()} == set(got)  # few enough words a slice for many passes


def test_leaks_of_items_copied_often(spark):
    rng = random.Random(6)
    item = words(rng, 38).split()
    cut, edited = item[10:], [x if i % 4 else "changed" for i, x in enumerate(item)]
    texts = [item] * 2000 + [cut] * 25 + [item[:24]] * 25 + [edited] * 10 + [words(rng, 40).split() + item[:3]] * 10
    docs = spark.createDataFrame([(i, " ".join(["words", "before", *t, "and", "after"])) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    scores = {tuple(t): smith_waterman(brute.words(" ".join(item)), brute.words("words before " + " ".join(t) + " and after")) / (2 * len(item)) for t in map(tuple, texts)}
    want = {i: round(scores[tuple(t)], 6) for i, t in enumerate(texts) if scores[tuple(t)] >= 0.45}
    assert len(want) == 2060
    for more in ({}, {"chunk": 50}):
        assert {r.doc_id: round(r.score, 6) for r in decontam.find_leaks(docs, bench, decontam.DecontamParams(**more)).collect()} == want


def test_bound_is_never_below_the_score():
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    w, bench = k.Words(pa.array(texts)), decontam._bench(pa.array(texts[:20]), list(range(20)), 3)
    item, doc = (x.ravel() for x in np.meshgrid(np.arange(20), np.arange(60)))
    bound = decontam._bounds(w, bench, item, w.first[doc], w.first[doc + 1])
    score = [smith_waterman(texts[i].split(), texts[d].split()) for i, d in zip(item, doc)]
    assert (bound >= score).all() and (bound[item == doc] == np.array(score)[item == doc]).all()


def test_leaks_on_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, odd_rows()[0][1]), (2, None), (3, ""), (None, "null id"), (4, "one"), (1, "twice the id")], "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(odd, bench).collect()}
    assert {(1, 1), (2, 1), (3, 1), (14, 1), (8, 4), (9, 4)} <= got and not {d for d, _ in got} & {4, 5, 6, None}
    assert decontam.find_leaks(empty, bench).count() == 0
    assert decontam.find_leaks(odd, bench.limit(0)).count() == 0
    left = decontam.drop_leaks(odd, bench)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} >= {None, 4, 5, 6, 7}


def test_leaks_of_null_ids_and_shared_ids_go(spark):
    item = odd_rows()[0][1]
    docs = spark.createDataFrame([(None, item), (None, "clean words"), (1, "before " + item), (1, "clean words too"), (2, None)], "doc_id long, text string")
    left = decontam.drop_leaks(docs, spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert {(r.doc_id, r.text) for r in left.collect()} == {(None, "clean words"), (1, "clean words too"), (2, None)} and left.count() == 3


# --- 4: sharding ---------------------------------------------------------------------------------------


def test_shards_match_sql(spark, small):
    got = sharding.assign_shards(small, 7).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(sharding.ORACLE.format(docs="documents", columns="doc_id, n_bytes, byte_start", n=7)).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()
    whole = sharding.shard_documents(small, 7)
    assert whole.columns == [*small.columns, "shard_id"]
    assert dict(whole.select("doc_id", "shard_id").collect()) == dict(zip(want.doc_id, want.shard_id))


def test_shards_on_odd_rows(odd, empty):
    rows = sharding.assign_shards(odd, 4).collect()
    assert len(rows) == odd.count() and {r.shard_id for r in rows} <= set(range(4))
    assert all(r.n_bytes == 0 for r in rows if r.doc_id in (4, 5))
    assert len({r.shard_id for r in rows if r.doc_id == 1}) == 1
    assert sharding.shard_documents(odd, 4).count() == odd.count()
    assert sharding.assign_shards(empty, 4).count() == 0 and sharding.shard_documents(empty, 4).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(odd, 0)


# --- 5, 6: repeated substrings ----------------------------------------------------------------------------


def windows(spans, least=50):
    return {(i, w) for i, a, n in spans for w in range(a, a + n - least + 1)}


@pytest.mark.parametrize("find", [suffix.repeated_spans, debruijn.repeated_substrings])
def test_repeats_match_brute_force(small, find):
    docs = small.select("doc_id", "text")
    want = brute.repeated_spans([(r.doc_id, r.text) for r in docs.collect()], 50)
    got = {(r.doc_id, r.start_word, r.n_words) for r in find(docs).collect()}
    assert windows(got) == windows(want)
    if find is debruijn.repeated_substrings:
        assert got == want


@pytest.mark.parametrize("find,params", [(suffix.repeated_spans, suffix.SuffixParams(least=9, anchor=3, first=2)), (debruijn.repeated_substrings, debruijn.GraphParams(least=9, anchor=3, k=5))])
def test_repeats_in_a_tangled_corpus(spark, find, params):
    """Few different words, so that paths branch everywhere, and periodic texts, which overlap themselves."""
    rng = random.Random(6)
    parts = [" ".join(rng.choice("abc") for _ in range(rng.randint(4, 14))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(100, "x y " * 30), (101, "z " * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.start_word, r.n_words) for r in find(docs, params).collect()}
    assert windows(got, 9) == windows(brute.repeated_spans(rows, 9), 9)


@pytest.mark.parametrize("find", [suffix.repeated_spans, debruijn.repeated_substrings])
def test_repeats_on_odd_rows(odd, empty, find):
    got = {(r.doc_id, r.start_word, r.n_words) for r in find(odd).collect()}
    spans = {(i, a) for i, a, n in got if n >= 50}
    assert {(1, 0), (2, 0), (14, 60), (10, 0), (11, 5)} <= spans
    assert not {i for i, _ in spans} & {4, 5, 6, 8, 9, 12, None}
    assert find(empty).count() == 0


def test_copies_leave_one_of_each_window(small):
    rows = suffix.repeated_spans(small).collect()
    text = {r.doc_id: brute.words(r.text) for r in small.collect()}
    first, later = {}, set()
    for r in rows:
        for a in range(r.start_word, r.start_word + r.n_words - 49):
            w = tuple(text[r.doc_id][a : a + 50])
            if r["copy"]:
                later.add(w)
            else:
                assert w not in first
                first[w] = r.doc_id
    assert later == set(first)


def test_paths_compact_over_pieces_and_cycles(spark):
    pieces = spark.createDataFrame([(0, 2, None), (10, 3, 1), (20, 1, 12), (30, 2, 41), (40, 2, 31), (50, 1, None)], "piece long, n long, link long")
    got = {r.piece: r["head"] for r in debruijn.compact(pieces).df.collect()}
    assert got == {0: 0, 10: 0, 20: 0, 30: 30, 40: 30, 50: 50}


# --- 8: n-gram join ---------------------------------------------------------------------------------------


def test_pairs_match_brute_force(small):
    want = brute.similar_pairs([(r.doc_id, r.text) for r in small.collect()], 3, 0.5)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.similar_pairs(small).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_pairs_of_a_large_group_and_its_tiles(spark):
    rng = random.Random(7)
    base = words(rng, 120).split()
    rows = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(120)] = f"w{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.similar_pairs(rows, 3, 0.5)
    got = ngram_join.similar_pairs(docs, ngram_join.JoinParams(tile=8, bucket_tile=16)).collect()
    assert len(got) == len({(r.doc_a, r.doc_b) for r in got}) and len(got) >= 0.98 * len(want)
    assert {(r.doc_a, r.doc_b) for r in got} <= set(want)


def brute_links(rows):
    """Id -> (least id of its class, number of links), from all pairs."""
    pairs = brute.similar_pairs(rows, 3, 0.5)
    root, links = brute.components(pairs), {}
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    return {i: (root.get(i, i), links.get(i, 0)) for i, _ in rows if i is not None}


def test_query_gives_one_row_for_each_document(spark, tmp_path):
    """Exact and near copies, as many rows as documents: 60 copies alone would be 1,770 pairs."""
    rng = random.Random(21)
    base = words(rng, 100).split()
    rows = [(i, " ".join(base)) for i in range(60)]
    for i in range(60, 80):
        w = list(base)
        w[i] = f"w{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, words(rng, 50)) for i in range(80, 100)] + [(100, None), (101, "  "), (102, "x"), (103, "x"), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_ngram_jaccard_join(spark, str(tmp_path)).collect()
    assert len(got) == 104
    assert {r.doc_id: (r.class_id, r.links) for r in got} == brute_links(rows)


def test_links_of_ids_with_several_texts(spark):
    """A document of two texts links the classes of both; whoever has a text like either one counts once."""
    rng = random.Random(22)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [("e", a), ("e", b), ("f", a), ("f", b), ("g", b), ("h", a + " more"), ("i", c), ("j", c + " more"), ("j", "other words"), ("k", "other words"), ("l", None), ("g", None), ("e", a)]
    got = ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id string, text string"), ngram_join.JoinParams(tile=2, bucket_tile=2)).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in got} == brute_links(rows) and len(got) == 8
    assert {r.doc_id: r.links for r in got}["e"] == 3


def test_links_match_brute_force(small, odd, empty):
    want = brute_links([(r.doc_id, r.text) for r in odd.collect()])
    assert {r.doc_id: (r.class_id, r.links) for r in ngram_join.linked_documents(odd).collect()} == want
    want = brute_links([(r.doc_id, r.text) for r in small.collect()])
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.linked_documents(small).collect()}
    assert set(got) == set(want) and sum(got[i] == want[i] for i in got) >= 0.9 * len(want)
    assert all(got[i][1] <= want[i][1] for i in got)
    assert ngram_join.linked_documents(empty).count() == 0


def near_copies(rng, n, most):
    base, rows = words(rng, 120).split(), []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(120), rng.randint(1, most)):
            w[at] = f"w{rng.random()}"
        rows.append((f"id{i:04d}", " ".join(w)))
    return rows


@pytest.mark.parametrize("params", [ngram_join.JoinParams(), ngram_join.JoinParams(tile=8, bucket_tile=16, pivots=3, tile_size=2000)])
def test_groups_take_edges_in_proportion(spark, monkeypatch, params):
    """Near copies, with text ids: edges grow with the members and not with their square; the groups are those of all pairs."""
    edges, stored = {}, ngram_join.Stored

    class Counted(stored):
        def __init__(self, df, name):
            super().__init__(df, name)
            if name == "forest":
                edges[n] = edges.get(n, 0) + self.df.count()

    monkeypatch.setattr(ngram_join, "Stored", Counted)
    for n in (50, 200):
        rows = near_copies(random.Random(n), n, 5) + [(f"other{i}", words(random.Random(i), 60)) for i in range(20)]
        left = {r.doc_id for r in ngram_join.drop_near_copies(spark.createDataFrame(rows, "doc_id string, text string"), params).collect()}
        root = brute.components(brute.similar_pairs(rows, 3, 0.5))
        assert left == {i for i, _ in rows if root.get(i, i) == i}
    assert edges[200] < 10 * edges[50] and edges[200] < 200 * 20  # all pairs would be 16 times as many; a member has an edge for each band at most


def test_rows_equal_in_id_and_text(spark):
    text = words(random.Random(1), 40)
    docs = spark.createDataFrame([(1, text, "b"), (1, text, "a"), (None, text, "c"), (None, "two words", "d"), (None, "two words", "e"), (None, None, "f"), (None, None, "g")], "doc_id long, text string, n string")
    left = sorted((r.doc_id is None, r.text is None, r.n) for r in ngram_join.drop_near_copies(docs).collect())
    assert [x[:2] for x in left] == [(False, False), (True, False), (True, True), (True, True)]


def test_filters_are_the_same_by_broadcast_and_by_shuffle(spark, odd):
    from corvane.llm.common import Stored, by_keys

    held = Stored(spark.createDataFrame([(1, "s"), (None, None), (4, "s")], "d int, s string"), "held")
    keys = {"d": F.col("doc_id"), "s": F.col("source")}
    for how in ("left_anti", "left_semi"):
        got = [sorted(map(str, by_keys(odd, held, keys, how, most).collect())) for most in (1 << 20, 0)]
        assert got[0] == got[1] and 0 < len(got[0]) < odd.count()
    held.drop()


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(0)
    for t in range(60):
        m = int(rng.integers(1, 40))
        g = rng.random((m, m)) < rng.choice([0.01, 0.05, 0.2, 0.9])
        g |= g.T
        label = rng.integers(0, m, m) if t % 2 else np.arange(m)
        i, j, out = spanning_forest(label, lambda i, j: np.ones(len(i), bool), lambda i, j: g[i, j], at_once=50)
        same = [(a, b) for a in range(m) for b in range(m) if label[a] == label[b]]
        want = brute.components(same + list(zip(*np.nonzero(g))))
        got = brute.components(same + list(zip(i.tolist(), j.tolist())))
        groups = lambda c: {(a, b) for a in range(m) for b in range(m) if c[a] == c[b]}
        assert groups(want) == groups(got) == groups(dict(enumerate(out.tolist()))) and len(i) < max(m, 1)


def test_pruning_keeps_pairs_at_the_threshold():
    need = ngram_join.least_matches(0.7, 0.005, [16, 64, 125])
    from math import comb

    p = 0.7 + 0.3 / 256
    for n, m in zip([16, 64, 125], need):
        lost = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(m))
        assert lost < 0.02
    assert need[2] > need[1] > need[0] > 0


def test_pairs_on_odd_rows(odd, empty):
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.similar_pairs(odd).collect()}
    want = brute.similar_pairs([(r.doc_id, r.text) for r in odd.collect()], 3, 0.5)
    assert got == pytest.approx(want) and got[1, 2] == 1.0 and got[8, 9] == 1.0 and (1, 3) in got
    assert ngram_join.similar_pairs(empty).count() == 0
    left = ngram_join.drop_near_copies(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i) == [1, 4, 5, 6, 7, 8, 8, 10, 11, 12, 13] and ids.count(None) == 1  # the null id with a text is a copy of 1
    assert ngram_join.drop_near_copies(empty).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (7, 7)]
    want = brute.components([e for e in edges if e[0] != e[1]])
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"))
    assert {r.node: r.root for r in got.df.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).df.count() == 0


# --- 9: lines ---------------------------------------------------------------------------------------------


def test_lines_match_brute_force(small):
    want = brute.duplicate_lines([(r.doc_id, r.text) for r in small.collect()], 8, 0.7)
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_dedup.duplicate_lines(small).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert sum(got[x] == want[x] for x in got) >= 0.97 * len(got)


def test_short_lines_with_a_small_change(spark, small, tmp_path):
    lines = ["copyright 1998 by the writers, all rights kept .", "Copyright 1975 by the writers, all rights kept .", "copyright 1997 by the writers, all rights kept .", "printed in another town by somebody else in 1998"]
    lines += ["the meeting of the town council begins at nine in the old hall", "the meeting of the town council begins at eight in the old hall"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.keep_doc_id) for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(1, 0), (2, 0), (5, 4)}
    want = brute.duplicate_lines([(r.doc_id, r.text) for r in small.collect()], 5, 0.7)
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in queries.op9_line_dedup(spark, SF).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)


def test_lines_on_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_dedup.duplicate_lines(odd).collect()}
    assert got == brute.duplicate_lines(rows, 8, 0.7)
    assert line_dedup.duplicate_lines(empty).count() == 0
    docs = spark.createDataFrame([(1, "Keep me here\n\nsame line of text"), (2, "SAME line of text \r\nother words entirely"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.remove_duplicate_lines(docs).collect()}
    assert out == {1: "Keep me here\n\nsame line of text", 2: "other words entirely", 3: None}


def test_lines_with_text_ids_and_clashing_columns(spark):
    base = "the meeting of the town council begins at nine in the old hall"
    docs = spark.createDataFrame([("b", base, 1, 2), ("a", "first line here\n" + base.upper(), 3, 4), ("c", base.replace("nine", "ten"), 5, 6)], "doc_id string, text string, dedup_id int, dedup_lines int")
    out = line_dedup.remove_duplicate_lines(docs, line_dedup.NEAR)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {"a": "first line here\n" + base.upper(), "b": "", "c": ""}


def test_a_bucket_of_ten_thousand_lines(spark):
    """Lines that differ in a number share their bands: one component, few edges; a stranger beside them stays."""
    lines = [f"page {i} of this very long report on the state of the roads and bridges in the northern parts of the country" for i in range(10_000)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 100 : i * 100 + 100])) for i in range(100)] + [(1000, "something else altogether is written here")], "doc_id long, text string")
    got = line_dedup.duplicate_lines(docs, line_dedup.NEAR).collect()
    assert len(got) == 9_999 and {(r.keep_doc_id, r.keep_line_no) for r in got} == {(0, 0)}


def test_lines_that_share_a_band_by_chance_are_no_candidates():
    """They grow with the square of the lines: all but a few must go before anything is joined, and no near copy with them."""
    rng, p = random.Random(12), line_dedup.NEAR
    lines = list({" ".join("".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(25)) for _ in range(4000)})
    near = [x[:60] + "zz" + x[62:] for x in lines]
    keys, sketch = line_dedup.line_keys(pa.array(lines + near), p)
    apart = np.bitwise_count(sketch[: len(lines)] ^ sketch[len(lines) :])
    assert (apart <= p.most_bits).mean() > 0.99
    held = {}
    for i, row in enumerate(keys[: len(lines)].tolist()):
        for x in row:
            held.setdefault(x, []).append(i)
    i, j = np.array([(a, b) for x in held.values() for n, a in enumerate(x) for b in x[n + 1 :]]).T
    assert len(i) > 100 and (np.bitwise_count(sketch[i] ^ sketch[j]) <= p.most_bits).mean() < 0.2


def test_bucket_forests_connect_what_likely_pairs_connect(monkeypatch):
    rng = np.random.default_rng(13)
    size = np.array([1, 2, 3, 5, 8, 9, 12, 16, 17, 40, 70, 2, 3])
    first = np.cumsum(size) - size
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    sketch = base[rng.integers(0, 40, size.sum())]
    for _ in range(7):
        sketch = sketch ^ np.uint64(1) << rng.integers(0, 64, len(sketch)).astype(np.uint64)
    for most in (4, 9, 12):
        likely = [(a, b) for f, n in zip(first.tolist(), size.tolist()) for a in range(f, f + n) for b in range(a + 1, f + n) if np.bitwise_count(sketch[a] ^ sketch[b]) <= most]
        for shortest in (1024, 4):
            monkeypatch.setattr(line_dedup, "SHORTEST", shortest)
            i, j, tree = line_dedup.bucket_forests(first, size, sketch, most)
            assert {(min(e), max(e)) for e in zip(i.tolist(), j.tolist())} <= set(likely)
            want = brute.components(likely + [(a, a) for a in range(len(sketch))])
            assert brute.components([*zip(i.tolist(), j.tolist()), *((a, a) for a in range(len(sketch)))]) == want
            assert brute.components(enumerate(tree.tolist())) == want and (tree[tree] == tree).all()
            assert len(i) == len(sketch) - len(set(want.values()))


@pytest.mark.parametrize("together, size", [(4096, 16 << 20), (3, 16 << 20), (4096, 2000), (1, 1)])
def test_connected_lines_in_one_task_and_in_blocks(spark, monkeypatch, together, size):
    """Groups of near copies, some of them just below the threshold from each other: the same lines go whichever way they are compared."""
    monkeypatch.setattr(line_dedup, "TOGETHER", together)
    monkeypatch.setattr(line_dedup, "TOGETHER_BYTES", size)
    rng, rows = random.Random(14), []
    for group in range(6):
        base = words(rng, 40).split()
        for _ in range((2, 3, 5, 20, 30, 40)[group]):
            w = list(base)
            for at in rng.sample(range(40), rng.randint(0, 6)):
                w[at] = words(rng, 1)
            rows.append((len(rows), words(rng, 12) + "\n" + " ".join(w)))
    want = brute.duplicate_lines(rows, 5, 0.7)
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), line_dedup.NEAR).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 50
    assert sum(got[x] == want[x] for x in got) >= 0.97 * len(got)


def test_texts_are_split_once_and_all_places_kept(spark, monkeypatch):
    """A line of 300 documents in many tasks, repeated rows and all: one pass over the texts finds each place."""
    read, texts = [], line_dedup.texts
    monkeypatch.setattr(line_dedup, "texts", lambda *args: read.append(1) or texts(*args))
    rng = random.Random(15)
    line = words(rng, 20)
    rows = [(i, "\n".join([words(rng, 10), line, words(rng, 10), line.upper()][i % 3 :])) for i in range(300)]
    rows += rows[:40]
    rng.shuffle(rows)
    got = [((r.doc_id, r.line_no), (r.keep_doc_id, r.keep_line_no)) for r in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), line_dedup.NEAR).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute.duplicate_lines(rows, 5, 0.7) and len(got) > 400
    assert len(read) == 1


def test_distinct_lines_over_batches(monkeypatch):
    monkeypatch.setattr(line_dedup.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
    rng = random.Random(3)
    rows = sorted((rng.randrange(6), rng.randrange(2), rng.randrange(4), rng.randrange(3)) for _ in range(200))
    table = pa.table([*(pa.array(x, pa.int64()) for x in list(zip(*rows))[:3]), pa.array([r[3] for r in rows], pa.int32()), pa.array([f"{r[0]}-{r[1]}" for r in rows])], ["h1", "h2", "doc_id", "line_no", "line"])
    want = {}
    for a, b, d, n in rows:
        want.setdefault((a, b), []).append((d, n))
    for size in (1, 2, 7, 200):
        got = pa.Table.from_batches(line_dedup._distinct(iter(table.to_batches(max_chunksize=size)))).to_pylist()
        assert {(r["h1"], r["h2"]): (r["doc_id"], r["line_no"], r["n"], r["line"]) for r in got} == {x: (*min(p), len(set(p)), f"{x[0]}-{x[1]}") for x, p in want.items()}
        assert [r["id"] for r in got] == list(range(3 << 32, (3 << 32) + len(want)))


def test_shingles_stay_inside_lines():
    rng = random.Random(9)
    lines = [words(rng, 8), "", "short", "ab", words(rng, 9), "exactly8", "éééé"]
    x, offsets = line_dedup.char_shingles(pa.array(lines), 8)
    for i, line in enumerate(lines):
        raw = line.encode()
        want = {raw[j : j + 8] for j in range(len(raw) - 7)} or ({raw} if raw else set())
        assert len(set(x[offsets[i] : offsets[i + 1]].tolist())) == len(want)
    assert offsets[-1] == len(x)


def test_split_lines_matches_plain_splitting():
    texts = ["A b\n\n c\t\n", None, "", "one", "\n\nx\r\ny  z ", " \n "]
    row, number, line = line_dedup.split_lines(pa.array(texts))
    want = [(i, j, x.replace("\t", " ").replace("\r", " ").strip(" ").lower()) for i, t in enumerate(texts) for j, x in enumerate((t or "").split("\n"))]
    assert list(zip(row.tolist(), number.tolist(), line.to_pylist())) == [w for w in want if w[2]]


# --- 10: mixing -------------------------------------------------------------------------------------------


def test_flight_keeps_totals_and_leaves_two():
    rng = np.random.default_rng(10)
    n, t, pi = rng.integers(1, 3, 500).astype(float), rng.integers(0, 900, 500).astype(float), np.full(500, 0.3)
    x = cube.fly(pi.copy(), n, t, pi, rng)
    open_ = ((x > 1e-9) & (x < 1 - 1e-9)).sum()
    assert open_ <= 2
    assert np.isclose((x * n / pi).sum(), n.sum()) and np.isclose((x * t / pi).sum(), t.sum())
    assert set(np.unique(cube.land(x, n, t, pi, rng))) <= {0.0, 1.0}
    same = cube.fly(np.full(60, 0.5), np.ones(60), np.full(60, 7.0), np.full(60, 0.5), rng)
    assert ((same > 1e-9) & (same < 1 - 1e-9)).sum() <= 2 and np.isclose(same.sum(), 30)


def test_flight_is_unbiased():
    rng = np.random.default_rng(11)
    t, pi = np.array([5.0, 1, 9, 4, 4, 7]), np.full(6, 0.4)
    mean = np.mean([cube.land(pi.copy(), np.ones(6), t, pi, rng) for _ in range(3000)], 0)
    assert np.abs(mean - 0.4).max() < 0.04


def test_mixture_hits_its_weights(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 10 < 6, "big").when(F.col("doc_id") % 10 < 9, "mid").otherwise("small"))
    p = cube.MixParams(weights={"big": 0.4, "mid": 0.4, "small": 0.2}, rate=0.8, block=64)
    got = cube.mix_sources(docs, p).toPandas()
    assert len(got) == docs.count() and got.doc_id.is_unique
    taken = got[got.selected]
    share = taken.groupby("source").n_tokens.sum() / taken.n_tokens.sum()
    assert abs(share["big"] - 0.4) < 0.02 and abs(share["small"] - 0.2) < 0.02
    for s, g in got.groupby("source"):
        assert abs(g.selected.sum() - g.probability.sum()) <= 3
        assert abs((g.n_tokens * g.selected).sum() - (g.n_tokens * g.probability).sum()) <= 2 * g.n_tokens.max()
    again = cube.mix_sources(docs.repartition(7), p).toPandas()
    assert set(again[again.selected].doc_id) == set(taken.doc_id)


def test_sample_matches_a_plain_cube(small):
    """Same seed, same sample: probabilities by bisection, flight and landing in plain Python."""
    p = cube.MixParams(miss=0.001, keep=0.4)
    got = cube.mix_sources(small, p).toPandas()
    rows = small.select("doc_id", "source", F.xxhash64("doc_id", "source", F.xxhash64("text")).alias("unit"), "text").collect()
    tokens = {}
    for r in rows:
        tokens[r.source] = tokens.get(r.source, 0) + len(re.findall(r"\S+", r.text))
    pi = brute.inclusion(tokens, p.alpha, p.miss, p.keep)
    numbers = {s: i for i, s in enumerate(sorted(tokens))}
    assert all(abs(r.probability - pi[r.source]) < 1e-6 for r in got.itertuples()) and 0.2 < got.selected.mean() < 0.9
    exact = dict(zip(got.source, got.probability))
    taken = brute.cube_sample([(numbers[r.source], r.unit, r.source, 1.0, float(len(re.findall(r"\S+", r.text)))) for r in rows], exact, p.seed)
    assert set(got[got.selected].doc_id) == {r.doc_id for r in rows if r.unit in taken}


def test_tiny_and_null_sources_do_not_set_the_size(spark):
    big = {"a": 900_000, "b": 600_000, "c": 400_000}
    before = cube.inclusion(big, cube.MixParams())
    for tiny in ({None: 10}, {"mistyped": 10, None: 3, "": 0}):
        pi = cube.inclusion(big | tiny, cube.MixParams())
        assert all(pi[s] == 1 for s in tiny) and all(abs(pi[s] - before[s]) < 0.01 for s in big)
    # many small sources beside a hot one: at least half of the tokens, small sources whole
    many = {i: 100 for i in range(1000)} | {"hot": 900_000}
    pi = cube.inclusion(many, cube.MixParams())
    assert abs(sum(pi[s] * n for s, n in many.items()) - 500_000) < 1 and pi[0] == 1
    # the shortfall goes to the others by their weights; given weights hold but for ``miss``
    pi = cube.inclusion({"a": 1000, "b": 1000, "c": 10}, cube.MixParams(weights={"a": 0.3, "b": 0.2, "c": 0.5}, keep=0.5))
    assert pi["c"] == 1 and abs(pi["a"] / pi["b"] - 1.5) < 1e-9 and abs(pi["a"] * 1000 + pi["b"] * 1000 - 995) < 1e-6
    given = {"a": 0.5, "b": 0.25, "c": 0.25}
    pi = cube.inclusion(big, cube.MixParams(weights=given))
    size = sum(pi[s] * n for s, n in big.items())
    assert sum(max(0, w - pi[s] * big[s] / size) for s, w in given.items()) <= 0.01 + 1e-9
    assert cube.inclusion({"a": 10, "b": 5}, cube.MixParams(alpha=1.0)) == {"a": 1.0, "b": 1.0}

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(-1, "one two three", None), (-2, "four five six seven", "mistyped")], docs.schema)
    got = cube.mix_sources(docs.unionByName(odd)).toPandas()
    plain = cube.mix_sources(docs).toPandas()
    kept, was = ((x.n_tokens * x.selected).sum() / x.n_tokens.sum() for x in (got, plain))
    assert kept > 0.5 and abs(kept - was) < 0.02
    assert got[got.doc_id < 0].selected.all()


def test_mixing_on_odd_rows(odd, empty):
    got = cube.mix_sources(odd, cube.MixParams(rate=0.5)).collect()
    assert len(got) == odd.count()
    kept = cube.sample_documents(odd, cube.MixParams(rate=0.5))
    assert kept.columns == odd.columns and kept.count() == sum(r.selected for r in got)
    assert cube.mix_sources(empty).count() == 0 and cube.sample_documents(empty).count() == 0
    none = cube.mix_sources(odd, cube.MixParams(weights={}))
    assert none.where("selected and n_tokens > 0").count() == 0
