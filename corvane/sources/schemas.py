"""Schemas of the evidence model, every field nullable; loaders add the input ordinal ``ord``."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


_EPISODE = "episode_number INT, episode_title STRING, episode_url STRING, episode_date STRING"
_CITATION = "citation_label STRING, pubmed_url STRING, canonical_key STRING, study_type STRING, score DOUBLE"
_LINK = "canonical_key STRING, citation_label STRING, paper_title STRING, support STRING, confidence STRING, rationale STRING, review_status STRING, reviewed_at STRING, review_note STRING"

EPISODES = "url STRING, title STRING, date STRING, episode_number INT, show_notes STRING"
TRANSCRIPTS = "episode_url STRING, episode_number INT, source STRING, ai_generated BOOLEAN, text STRING"
MENTIONS = f"""citation_label STRING, paper_title STRING, pubmed_url STRING, year STRING, brief_summary STRING, context_topic STRING, study_type STRING,
    specialty_tags ARRAY<STRING>, segment STRING, nct_id STRING, sample_size INT, journal STRING, episode_category STRING, {_EPISODE}"""
STATEMENTS = f"""topic STRING, pearl STRING, specialty_tags ARRAY<STRING>, segment STRING, clinical_topic STRING, episode_category STRING, {_EPISODE},
    supporting_citations ARRAY<STRUCT<{_CITATION}>>"""
LINK_RECORDS = f"episode_url STRING, pearl_key STRING, pearl STRING, review_status STRING, reviewed_by STRING, links ARRAY<STRUCT<{_LINK}>>"
SCREENING = """canonical_key STRING, grounded_in STRING, population STRING, intervention STRING, comparator STRING, outcome STRING, clinical_bottom_line STRING,
    applicability STRING, study_quality_limitations STRING, confidence STRING, review_status STRING, reviewed_by STRING"""
CANDIDATES = "episode_url STRING, statement STRING, supporting_quote STRING, topic STRING, review_status STRING, reviewed_by STRING, quote_verified BOOLEAN"
STATE = "episode_url STRING, status STRING, chunk_count INT, raw_mentions INT, deduped_mentions INT, error STRING"
MANIFEST = f"custom_id STRING, {_EPISODE}, chunk_index INT, total_chunks INT"
FEEDBACK = """id BIGINT, submitted_at TIMESTAMP, target_type STRING, pearl_key STRING, pearl_text_snapshot STRING, canonical_key STRING, reason_code STRING,
    comment STRING, episode_url STRING, client_ip_hash STRING, review_status STRING"""
