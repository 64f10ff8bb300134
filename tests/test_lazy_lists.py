"""Counts of records don't collect the lists of their episodes and citations."""

from corvane.operators import canonical
from corvane.plans import record_queries
from corvane.plans.base import Tables


def test_counts_collect_no_lists(spark):
    links = canonical.show_note_links(record_queries._episodes(Tables(spark, "/root/testdata/sf0.001")))
    counts = canonical.show_note_evidence(links)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "episode_number" in plan(counts.select("evidence_key", "episodes"))
    assert "collect_list" in plan(counts.select("evidence_key", "episodes"))
    assert "collect_list" not in plan(counts.select("evidence_key", "link_count", "episode_count"))
    first = counts.select("evidence_key", "episode_count", "episodes").first()
    assert len(first.episodes) == first.episode_count
