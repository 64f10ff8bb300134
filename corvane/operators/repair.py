"""Migration repairs: states without a reviewer, stale keys of links and screening records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text

_KEPT = "support confidence rationale review_status reviewed_at review_note".split()


def downgrade_unattributed(records: DataFrame) -> DataFrame:
    """Approvals that no person made become ``auto_triaged``; their time moves to ``triaged_at``."""
    note = F.lower(F.coalesce("review_note", F.lit("")))
    hit = (F.col("review_status") == "approved") & (note.contains("auto-clear") | note.contains("spot-check") | ~text.truthy("reviewed_by"))
    hit = F.coalesce(hit, F.lit(False))
    before = F.col("triaged_at") if "triaged_at" in records.columns else F.lit(None).cast(records.schema["reviewed_at"].dataType)
    return records.withColumns({"triaged_at": F.when(hit, F.col("reviewed_at")).otherwise(before), "reviewed_at": F.when(~hit, F.col("reviewed_at")), "review_status": F.when(hit, F.lit("auto_triaged")).otherwise(F.col("review_status"))})


def repair_by_name(links: DataFrame, mentions: DataFrame, link_id: str) -> DataFrame:
    """Links with the key of their episode's mention of the same title or label, where exactly one key is found; ``repaired`` marks changed ones.

    ``links``: (link_id, episode_url, canonical_key, citation_label, paper_title, ...); ``mentions``: (episode_url,
    canonical_key, citation_label, paper_title). Names meet by equality of their normalised text, titles only titles.
    """
    sides = {"_t": "paper_title", "_l": "citation_label"}
    out = links
    for side, column in sides.items():
        named = mentions.where("canonical_key is not null").select(F.col("episode_url").alias(f"{side}u"), text.key_text(column).alias(f"{side}n"), "canonical_key").where(F.col(f"{side}n") != "")
        known = named.groupBy(f"{side}u", f"{side}n").agg(F.min("canonical_key").alias(f"{side}min"), F.max("canonical_key").alias(f"{side}max"))
        out = out.withColumn(f"{side}k", F.nullif(text.key_text(column), F.lit("")))
        out = out.join(known, (F.col("episode_url") == F.col(f"{side}u")) & (F.col(f"{side}k") == F.col(f"{side}n")), "left").drop(f"{side}u", f"{side}n", f"{side}k")
    # each link is looked up by itself: ids may repeat
    low, high = F.least("_tmin", "_lmin"), F.greatest("_tmax", "_lmax")
    out = out.withColumn("_new", F.when(low == high, low)).drop("_tmin", "_tmax", "_lmin", "_lmax")
    return out.withColumn("repaired", F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("canonical_key"))).withColumn("canonical_key", F.coalesce("_new", "canonical_key")).drop("_new")


def repair_screening(screening: DataFrame, evidence: DataFrame) -> DataFrame:
    """Screening records with a key that the evidence has: their own, else that of their ``pmid``, else of the one record with their label."""
    keys = evidence.select(F.col("canonical_key").alias("_k")).distinct()
    labels = evidence.select(text.key_text("citation_label").alias("_l"), F.col("canonical_key").alias("_lk"), F.col("citation_label").alias("_label")).where("_l <> ''")
    single = labels.groupBy("_l").agg(F.count("*").alias("_many"), F.min("_lk").alias("_by_label")).where("_many = 1").drop("_many")
    own = screening.join(keys, F.col("canonical_key") == F.col("_k"), "left").withColumnRenamed("_k", "_own")
    by_id = own.join(keys.withColumnRenamed("_k", "_by_id"), F.concat(F.lit("pmid|"), F.col("pmid").cast("string")) == F.col("_by_id"), "left")
    named = by_id.join(single, text.key_text("citation_label") == F.col("_l"), "left").withColumn("_new", F.coalesce("_own", "_by_id", "_by_label"))
    label = evidence.groupBy(F.col("canonical_key").alias("_lk")).agg(F.first("citation_label").alias("_label"))
    out = named.join(label, F.col("_new") == F.col("_lk"), "left").withColumn("repaired", F.col("_new").isNotNull() & F.col("_own").isNull())
    fixed = {"citation_label": F.when(F.col("repaired"), F.col("_label")).otherwise(F.col("citation_label")), "canonical_key": F.coalesce("_new", "canonical_key")}
    return out.withColumns(fixed).select(*screening.columns, "repaired")
