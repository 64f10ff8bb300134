"""Batch build of the gold tables from episodes, mentions, statements and reviewed sidecars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import canonical, validate
from corvane.operators.review import publishable
from corvane.operators.lineage import cut

SCREENED = tuple("applicability clinical_bottom_line comparator grounded_in intervention outcome population study_quality_limitations".split())


@dataclass(frozen=True)
class Gold:
    evidence: DataFrame
    statements: DataFrame
    show_notes: DataFrame
    stats: DataFrame


def approved_links(records: DataFrame) -> DataFrame:
    """Link records reduced to their publishable links, as the sidecar that ``attach_evidence_links`` reads."""
    rows = records.select("episode_url", "pearl", "ord", F.col("review_status").alias("record_status"), "reviewed_by", F.posexplode("links").alias("_i", "l"))
    rows = rows.select("*", F.col("l.review_status").alias("link_status"), F.col("l.support").alias("support"), F.col("l.confidence").alias("confidence")).where(publishable())
    lists = rows.groupBy("episode_url", "pearl", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "l"))), lambda x: x["l"]).alias("evidence_links"))
    return lists


def build(episodes: DataFrame, mentions: DataFrame, statements: DataFrame, link_records: DataFrame, screening: DataFrame | None = None, feedback: DataFrame | None = None) -> Gold:
    """Canonical evidence with show-note links, screening and backlinks; canonical statements with links and flags.

    Feedback is attached before stale link keys are repaired, so a flag on a repaired key isn't shown.
    """
    evidence = canonical.canonical_evidence(mentions)
    links = canonical.show_note_links(episodes)
    records = cut(canonical.match_show_notes(canonical.show_note_evidence(links), evidence))
    stats = canonical.merge_stats(records)
    merged = cut(canonical.merge_show_notes(evidence, records.drop("canonical_key"), links))
    if screening is not None:
        passed = screening.where((F.col("review_status") == "approved") & (F.coalesce("reviewed_by", F.lit("")) != ""))
        merged = canonical.attach_screening(merged, passed, SCREENED)
    said = canonical.canonical_statements(canonical.attach_evidence_links(statements, approved_links(link_records)))
    if feedback is not None:
        said = canonical.attach_feedback(said, canonical.approved_feedback(feedback))
    said = cut(canonical.repair_links(said, merged))
    return Gold(canonical.attach_backlinks(merged, said), said, records, stats)


def check(gold: Gold, episodes: DataFrame) -> DataFrame:
    """(rule, violations) of the gold tables."""
    e, s = gold.evidence, gold.statements
    seen = e.select(F.explode("episodes.episode_url").alias("u"))
    linked = s.select(F.explode("evidence_links.canonical_key").alias("k"))
    return validate.report(
        [
            validate.unique(e, ["canonical_key"], "evidence keys are unique"),
            validate.unique(e, ["id"], "evidence ids are unique"),
            validate.any_present(e, ["citation_label", "paper_title", "pubmed_url"], "evidence has label, title or URL"),
            validate.violates(e, F.size("episodes") == 0, "evidence has an episode"),
            validate.known(seen, "u", episodes, "url", "evidence episodes are known"),
            validate.present(s, "pearl", "statements aren't blank"),
            validate.not_truncated(s, "pearl", "statements aren't cut"),
            validate.unique(s, ["pearl_key"], "statement keys are unique"),
            validate.known(linked, "k", e, "canonical_key", "links lead to evidence"),
            validate.matches(e, "nct_id", r"^NCT\d{8}$", "registry ids have their form"),
            validate.violates(e, F.col("sample_size") <= 0, "sample sizes are positive"),
            validate.unique(gold.show_notes, ["evidence_key"], "show-note keys are unique"),
        ]
    )
