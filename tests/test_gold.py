"""The batch build over small reference-shaped tables."""

import pytest
from pyspark.sql import functions as F

from corvane.functions.urls import LIBRARY
from corvane.operators import canonical
from corvane.plans import gold
from corvane.sources import schemas


def rows(spark, ddl, *records, ordinal=True):
    schema = schemas._schema(ddl)
    data = [tuple(r.get(f.name) for f in schema) for r in records]
    df = spark.createDataFrame(data, schema)
    if not ordinal:
        return df
    data = [(*d, i) for i, d in enumerate(data)]
    return spark.createDataFrame(data, schema.add("ord", "long"))


@pytest.fixture(scope="module")
def tables(spark):
    notes = f"See [Alpha trial](https://pubmed.{LIBRARY}/11111111/) and [Beta cohort](https://evidence.nejm.org/10.1056/Beta1) and [shop](https://www.amazon.com/x)"
    episodes = rows(
        spark, schemas.EPISODES,
        dict(url="e1", title="One", date="2024-01-01", episode_number=1, show_notes=notes),
        dict(url="e2", title="Two", date="2024-02-01", episode_number=2, show_notes=f"Again [Alpha](https://pubmed.{LIBRARY}/11111111?x=1) and [Gamma guideline](https://doi.org/10.1000/gamma)."),
        dict(url="e3", title="None", date=None, episode_number=None, show_notes=None),
    )
    base = dict(episode_url="e1", episode_title="One", episode_number=1, episode_date="2024-01-01")
    mentions = rows(
        spark, schemas.MENTIONS,
        dict(base, citation_label="Alpha 2020", paper_title="The Alpha Trial", pubmed_url=f"http://www.{LIBRARY}/pubmed/11111111", year="2020", study_type="rct", specialty_tags=["Cardiology", "junk"], context_topic="Heart"),
        dict(base, citation_label="Alpha", paper_title="The Alpha Trial of hearts", pubmed_url=f"https://pubmed.{LIBRARY}/11111111/", year="in 2020", study_type="other", specialty_tags=["nephrology"], episode_url="e2", episode_title="Two", episode_number=2),
        dict(base, citation_label="Delta", paper_title="n/a", pubmed_url=f"https://pubmed.{LIBRARY}/", year=None),
        dict(base, citation_label="null", paper_title=" ", pubmed_url=None),
        dict(base, citation_label="Delta", year=None, study_type="cohort"),
    )
    link = dict(canonical_key="label|alpha|None", citation_label="Alpha 2020", support="direct", confidence="high", rationale="r")
    statements = rows(
        spark, schemas.STATEMENTS,
        dict(pearl="Treat early (Doe 2020)", topic="Heart", specialty_tags=["cardiology"], **base, supporting_citations=[("Alpha", None, "k1", "RCT", 0.5), ("Alpha", None, "k1", "RCT", 0.7), ("Beta", None, "k2", "RCT", 0.7)]),
        dict(pearl="Treat early and often", topic=None, specialty_tags=None, **base, supporting_citations=None),
        dict(pearl="treat early", topic="Vessels", specialty_tags=["nephrology"], episode_url="e2", episode_title="Two", episode_number=2, supporting_citations=[("Alpha", None, "k1", "RCT", 0.9)]),
    )
    sidecar = rows(
        spark, schemas.LINK_RECORDS,
        dict(episode_url="e1", pearl="Treat early", review_status="approved", reviewed_by="r", links=[tuple(dict(link).get(k) for k in "canonical_key citation_label paper_title support confidence rationale review_status reviewed_at review_note".split()), ("pmid|11111111", "x", None, "background", "high", None, None, None, None)]),
        dict(episode_url="e1", pearl="Treat early and often", review_status="approved", reviewed_by=None, links=[("pmid|11111111", "x", None, "direct", "high", None, None, None, None)]),
    )
    feedback = rows(spark, schemas.FEEDBACK, dict(id=1, target_type="pearl", pearl_key="treat early", reason_code="outdated", review_status="approved"), dict(id=2, target_type="pearl", pearl_key="treat early", reason_code="outdated", review_status="approved"), dict(id=3, target_type="pearl", pearl_key="treat early", reason_code="unclear", review_status="pending"))
    return episodes, mentions, statements, sidecar, feedback


def test_canonical_evidence(spark, tables):
    got = {r.canonical_key: r for r in canonical.canonical_evidence(tables[1]).collect()}
    assert set(got) == {"pmid|11111111", "label|delta|None"}
    alpha = got["pmid|11111111"]
    assert (alpha.paper_title, alpha.citation_label, alpha.year, alpha.study_type) == ("The Alpha Trial of hearts", "Alpha 2020", 2020, "RCT")
    assert alpha.specialty_tags == ["cardiology", "nephrology"] and alpha.mention_count == 2 and alpha.episode_count == 2 and alpha.latest_episode_number == 2
    assert [e.episode_url for e in alpha.episodes] == ["e2", "e1"] and alpha.id == 0
    assert got["label|delta|None"].study_type == "other" and got["label|delta|None"].mention_count == 2


def test_dedupe_within_an_episode(tables):
    got = {(r.episode_url, r.canonical_key): r for r in canonical.dedupe_mentions(tables[1]).collect()}
    assert len(got) == 3 and got["e1", "label|delta|None"].mentions == 2


def test_show_note_merge_is_asymmetric(tables):
    episodes, mentions = tables[:2]
    evidence = canonical.canonical_evidence(mentions)
    links = canonical.show_note_links(episodes)
    records = canonical.match_show_notes(canonical.show_note_evidence(links), evidence)
    by_key = {r.evidence_key: r for r in records.collect()}
    assert set(by_key) == {"pmid|11111111", "doi|10.1056/beta1", "doi|10.1000/gamma"}
    assert by_key["pmid|11111111"].canonical_key == "pmid|11111111" and by_key["pmid|11111111"].link_count == 2
    merged = {r.canonical_key: r for r in canonical.merge_show_notes(evidence, records.drop("canonical_key"), links).collect()}
    assert merged["pmid|11111111"].show_note_link_count == 1  # one URL, though linked twice
    assert merged["show_note|doi|10.1000/gamma"].study_type == "guideline"
    assert merged["show_note|doi|10.1000/gamma"].source_layers == ["show_notes_links"]
    assert sorted(r.id for r in merged.values()) == list(range(4))
    stats = canonical.merge_stats(records).first()
    assert (stats.show_note_records, stats.matched_records, stats.show_note_link_mentions) == (3, 1, 4)


def test_statements_links_and_feedback(tables):
    built = gold.build(*tables[:4], feedback=tables[4])
    said = {r.pearl_key: r for r in built.statements.collect()}
    assert set(said) == {"treat early", "treat early and often"}
    early = said["treat early"]
    assert early.pearl == "Treat early (Doe 2020)" and early.topics == ["Heart", "Vessels"] and early.episode_count == 2
    assert [(c.canonical_key, c.score) for c in early.supporting_citations] == [("k1", 0.9), ("k2", 0.7)]
    assert [x.canonical_key for x in early.evidence_links] == ["pmid|11111111"]  # stale key repaired by label; background link not published
    assert early.flag_summary == {"outdated": 2}
    assert said["treat early and often"].evidence_links == []  # no reviewer, no links
    alpha = built.evidence.where("canonical_key = 'pmid|11111111'").first()
    assert alpha.linked_pearl_count == 1 and alpha.linked_pearls[0].pearl_key == "treat early"


def test_integrity_report(tables):
    built = gold.build(*tables[:4])
    report = {r.rule: r.violations for r in gold.check(built, tables[0]).collect()}
    assert sum(report.values()) == 0 and len(report) == 12


def test_screening_fills_only_what_it_has(spark, tables):
    evidence = canonical.canonical_evidence(tables[1])
    screening = rows(spark, schemas.SCREENING, dict(canonical_key="pmid|11111111", population="adults", outcome=""), dict(canonical_key="pmid|11111111", population="old adults", outcome=None))
    got = canonical.attach_screening(evidence, screening, ["population", "outcome"]).where("canonical_key = 'pmid|11111111'").first()
    assert got.population == "old adults" and got.outcome is None


def test_empty_tables(spark):
    empty = {name: rows(spark, getattr(schemas, name)) for name in ("EPISODES", "MENTIONS", "STATEMENTS", "LINK_RECORDS")}
    built = gold.build(*empty.values())
    assert built.evidence.count() == 0 and built.statements.count() == 0
    assert built.stats.first().show_note_records == 0
