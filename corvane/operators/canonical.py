"""Gold tables of the evidence model: canonical evidence, show-note evidence, canonical statements, and their links.

Nested arrays are built at the end only; the work in between is on long tables
(record-episode, record-citation, statement-link), keyed for equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text, urls, vocab
from corvane.operators import aggs
from corvane.operators.joins import first_wins, last_wins, once, together
from corvane.operators.lineage import cut
from corvane.operators.parsers import markdown_links

_TEXTS = ["citation_label", "paper_title", "pubmed_url", "brief_summary", "context_topic"]
_MODES = ["year", "study_type", "nct_id", "sample_size", "journal"]
_EPISODE = "episode_number episode_title episode_url episode_date".split()
_LINK_FIELDS = "citation_label journal nct_id paper_title pubmed_url sample_size study_type year".split()


def _tags(column: str) -> Column:
    """Tags of the vocabulary, clean and sorted, from an array."""
    clean = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.lower(text.clean_text(x)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isin(vocab.SPECIALTIES))))


def _union(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def normalize_mentions(df: DataFrame) -> DataFrame:
    """Clean mentions with their identity key; rows without label, title and URL are dropped."""
    # what names the publication repeats with its mentions, and its URL is the dearest to read
    link, title, label, yr = urls.normalize("pubmed_url"), text.clean_text("paper_title"), text.clean_text("citation_label"), text.year("year")
    named = {"pubmed_url": link, "paper_title": title, "citation_label": label, "year": yr, "canonical_key": urls.mention_key(link, title, label, yr)}
    df = once(df, ["pubmed_url", "paper_title", "citation_label", "year"], named)
    clean = {c: text.clean_text(c) for c in ("brief_summary", "context_topic", "segment", "journal", "episode_category", "episode_title", "episode_url", "episode_date")}
    # the order of columns is part of a fallback key
    out = df.select(
        "citation_label", "paper_title", *[v.alias(c) for c, v in clean.items()], "pubmed_url", "year", text.study_type("study_type").alias("study_type"),
        _tags("specialty_tags").alias("specialty_tags"), text.registry_id("nct_id").alias("nct_id"), F.when(F.col("sample_size") > 0, F.col("sample_size")).alias("sample_size"), "episode_number", "ord", "canonical_key",
    )
    out = out.where("citation_label is not null or paper_title is not null or pubmed_url is not null")
    fallback = F.concat(F.lit("fallback|"), F.sha2(F.to_json(F.struct(*[c for c in out.columns if c not in ("ord", "canonical_key")], "ord")), 256))
    return out.withColumn("canonical_key", F.coalesce("canonical_key", fallback))


def dedupe_mentions(df: DataFrame) -> DataFrame:
    """One mention per publication and episode: longest texts, first-seen modes, tag union."""
    rows = together(normalize_mentions(df).withColumn("_g", F.struct("episode_url", "canonical_key")), "_g")
    merged = aggs.merge_records(rows, "_g", [*_TEXTS, "episode_title", "episode_date"], [*_MODES, "episode_number"])
    tags = rows.groupBy("_g").agg(_union("specialty_tags").alias("specialty_tags"))
    return merged.join(tags, "_g").select("_g.episode_url", "_g.canonical_key", *[c for c in merged.columns if c != "_g"], "specialty_tags")


def _number() -> Column:
    return F.coalesce("episode_number", F.lit(0))


def _episodes(rows: DataFrame, key: str) -> DataFrame:
    """(key, episode_url, ...): one row for each episode of a key, with its first present number, title and date."""
    inner = rows.groupBy(key, "episode_url").agg(
        F.coalesce(aggs.first_present(F.nullif("episode_number", F.lit(0))), F.min("episode_number")).alias("episode_number"),
        aggs.first_present(F.nullif("episode_title", F.lit(""))).alias("episode_title"),
        aggs.first_present(F.nullif("episode_date", F.lit(""))).alias("episode_date"), F.min("ord").alias("_o"), F.max(text.truthy("episode_url")).alias("_known"),
    )
    # a test of the URL itself would go below a shared shuffle
    return inner.where("_known").drop("_known")


def _episode_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, episode_count, latest_episode_number)"""
    return _episodes(rows, key).groupBy(key).agg(F.count("*").cast("int").alias("episode_count"), F.max(_number()).alias("latest_episode_number"))


def _episode_lists(rows: DataFrame, key: str) -> DataFrame:
    """(key, episodes, episode_titles): newest first, then by title. One row holds all episodes of its key."""
    item = F.struct((-_number()).alias("a"), F.coalesce("episode_title", F.lit("")).alias("b"), F.col("_o").alias("c"), F.struct(*_EPISODE).alias("e"))
    lists = _episodes(rows, key).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    titles = F.filter(F.transform("_l", lambda x: x["e"]["episode_title"]), lambda t: t.isNotNull())
    return lists.select(key, F.transform("_l", lambda x: x["e"]).alias("episodes"), titles.alias("episode_titles"))


def _listed(df: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Numbered records with lists of theirs: joined after the numbering, which would write them, so only those who read them pay."""
    return _with_empty_lists(df.join(lists, key, "left"))


def _ordered(df: DataFrame, label: str, tie: str) -> DataFrame:
    return aggs.dense_ids(df, [F.coalesce("latest_episode_number", F.lit(0)).desc(), F.coalesce(label, F.lit("")), F.col(tie)])


def canonical_evidence(mentions: DataFrame) -> DataFrame:
    """One record per publication over all episodes, with dense ids in gold order."""
    rows = together(normalize_mentions(mentions), "canonical_key")
    merged = aggs.merge_records(rows, "canonical_key", _TEXTS, _MODES).withColumnRenamed("mentions", "mention_count")
    sets = rows.groupBy("canonical_key").agg(
        _union("specialty_tags").alias("specialty_tags"), aggs.sorted_set(F.col("segment")).alias("segments"),
        aggs.sorted_set(F.col("episode_category")).alias("episode_categories"), aggs.sorted_set(F.col("context_topic")).alias("context_topics"),
    )
    out = merged.join(sets, "canonical_key").join(_episode_counts(rows, "canonical_key"), "canonical_key", "left")
    out = out.withColumn("study_type", F.coalesce("study_type", F.lit("other"))).withColumn("source_layers", F.array(F.lit("model_extraction")))
    return _listed(_ordered(_with_counts(out), "citation_label", "first_ord"), _episode_lists(rows, "canonical_key"), "canonical_key")


def _with_counts(df: DataFrame) -> DataFrame:
    """Null counts of records without episodes become 0."""
    return df.withColumns({"episode_count": F.coalesce("episode_count", F.lit(0)), "latest_episode_number": F.coalesce("latest_episode_number", F.lit(0))})


def _with_empty_lists(df: DataFrame) -> DataFrame:
    """Null arrays of records without episodes become empty."""
    kind = "array<struct<episode_number:int,episode_title:string,episode_url:string,episode_date:string>>"
    return df.withColumns({"episodes": F.coalesce("episodes", F.array().cast(kind)), "episode_titles": F.coalesce("episode_titles", F.array().cast("array<string>"))})


def show_note_links(episodes: DataFrame, excluded: Sequence[str] | None = None) -> DataFrame:
    """Links of show notes that lead to publications, one row each, with key and ordinal."""
    base = episodes.select(F.col("url").alias("episode_url"), F.col("title").alias("episode_title"), "episode_number", F.col("date").alias("episode_date"), "show_notes", F.col("ord").alias("_e"))
    found = markdown_links(base, "show_notes", "_e")
    numbered = cut(found.withColumn("_p", F.monotonically_increasing_id()))
    # each distinct link is read once; addresses step by step, as each one is used several times
    pairs = numbered.select("label", "url").distinct().select("label", F.col("url").alias("_raw"), urls.canonical_form("url").alias("url"))
    pairs = cut(pairs.where(urls.likely_evidence("url", list(excluded) if excluded else None)).withColumn("evidence_key", urls.link_key("label", "url")).where("evidence_key is not null"))
    pairs = pairs.select(F.col("label").alias("_label"), "_raw", "url", "evidence_key", text.clean_text("label").alias("label"), urls.domain("url").alias("domain"))
    kept = numbered.withColumnsRenamed({"label": "_l", "url": "_u"}).join(pairs, F.col("_l").eqNullSafe(F.col("_label")) & F.col("_u").eqNullSafe(F.col("_raw"))).drop("_l", "_u", "_label", "_raw")
    rows = kept.join(base.drop("show_notes"), "_e")
    clean = rows.withColumns({c: text.clean_text(c) for c in ("episode_title", "episode_url", "episode_date")})
    return aggs.dense_ids(clean, [F.col("_e"), F.col("_p")], "ord").drop("_e", "_p")


def show_note_evidence(links: DataFrame) -> DataFrame:
    """One record per linked publication: commonest label, commonest URL, episodes, mentions."""
    counted = links.groupBy("evidence_key", "label").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    label = counted.groupBy("evidence_key").agg(F.max_by("label", F.struct("n", F.length("label"), -F.col("o"))).alias("citation_label"))
    url = aggs.first_seen_modes(links, ["evidence_key"], ["url"])
    rest = links.groupBy("evidence_key").agg(
        aggs.sorted_set(F.col("url")).alias("urls"), aggs.sorted_set(F.col("domain")).alias("domains"), F.count("*").alias("link_count"),
        aggs.first_present(text.year("label")).alias("year"), F.min("ord").alias("first_ord"),
    )
    out = rest.join(label, "evidence_key").join(url, "evidence_key", "left").join(_episode_counts(links, "evidence_key"), "evidence_key", "left")
    out = out.withColumn("study_type", urls.link_study_type("citation_label", "url"))
    return _listed(_ordered(_with_counts(out), "citation_label", "first_ord").drop("id"), _episode_lists(links, "evidence_key"), "evidence_key")


def _aliases(canonical: DataFrame) -> DataFrame:
    """(alias, canonical_key): the first record of each alias."""
    address = urls.canonical_form("pubmed_url")
    found = F.array(F.col("canonical_key"), F.concat(F.lit("url|"), address), F.when(address.isNotNull(), urls.link_key("citation_label", address)), F.concat(F.lit("nct|"), urls.nct("nct_id")))
    rows = canonical.select("canonical_key", "id", F.explode(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))).alias("alias"))
    return rows.groupBy("alias").agg(F.min_by("canonical_key", "id").alias("canonical_key"))


def match_show_notes(records: DataFrame, canonical: DataFrame) -> DataFrame:
    """Show-note records with the canonical key of the first alias that is known, else null."""
    per_url = F.flatten(F.transform("urls", lambda u: F.array(urls.link_key("citation_label", u), F.concat(F.lit("url|"), urls.canonical_form(u)))))
    tried = records.select("evidence_key", F.posexplode(F.concat(F.array("evidence_key"), per_url)).alias("level", "alias")).where("alias is not null")
    hit = tried.join(_aliases(canonical), "alias").groupBy("evidence_key").agg(F.min_by("canonical_key", "level").alias("canonical_key"))
    return records.join(hit, "evidence_key", "left")


def merge_show_notes(canonical: DataFrame, records: DataFrame, links: DataFrame) -> DataFrame:
    """Canonical records with their show-note citations, and link-only records as new ones.

    For matched records citations count once per (evidence key, URL); link-only
    records keep all their distinct mentions and the raw number of links.
    """
    matched = match_show_notes(records, canonical).withColumn("target", F.coalesce("canonical_key", F.concat(F.lit("show_note|"), "evidence_key")))
    mentions = first_wins(links, ["evidence_key", "label", "url", "episode_url"], "ord")
    rows = mentions.join(matched.select("evidence_key", "target", "canonical_key", F.col("citation_label").alias("_label")), "evidence_key").withColumn("label", F.coalesce("label", "_label"))
    attached = first_wins(rows.where("canonical_key is not null"), ["target", "evidence_key", "url"], "ord").unionByName(rows.where("canonical_key is null"))
    item = F.struct((-_number()).alias("a"), F.coalesce("label", F.lit("")).alias("b"), F.col("ord").alias("c"), F.struct("evidence_key", "label", "url", "episode_number", "episode_title", "episode_url").alias("e"))
    citations = attached.groupBy(F.col("target").alias("canonical_key")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("show_note_citations"))
    cited = attached.groupBy("target").agg(F.count("*").alias("_links"), F.count_distinct("episode_url").alias("show_note_episode_count"), F.min_by("url", "ord").alias("_url"))
    nested = ["episodes", "episode_titles"]
    known = canonical.drop("id", *nested).join(cited, canonical["canonical_key"] == cited["target"], "left")
    known = known.withColumn("pubmed_url", F.coalesce("pubmed_url", "_url")).withColumn("source_layers", F.when(F.col("target").isNotNull(), F.array(F.lit("model_extraction"), F.lit("show_notes_links"))).otherwise(F.col("source_layers")))
    known = known.withColumn("show_note_link_count", F.coalesce("_links", F.lit(0))).drop("target", "_links", "_url")
    lonely = matched.where("canonical_key is null").drop("canonical_key").join(cited.select("target"), "target", "left_semi")
    lonely = lonely.select(
        F.col("target").alias("canonical_key"), "citation_label", F.col("url").alias("pubmed_url"), "year", F.concat(F.lit("Cited in the show notes as: "), "citation_label", F.lit(".")).alias("brief_summary"),
        text.study_type("study_type").alias("study_type"), urls.nct("url").alias("nct_id"), F.col("link_count").alias("mention_count"), "episode_count", "latest_episode_number",
        F.col("link_count").alias("show_note_link_count"), F.col("episode_count").cast("long").alias("show_note_episode_count"), F.array(F.lit("show_notes_links")).alias("source_layers"),
        (F.col("first_ord") + (1 << 50)).alias("first_ord"),
    )
    both = known.unionByName(lonely, allowMissingColumns=True)
    done = _ordered(both.withColumn("show_note_episode_count", F.coalesce("show_note_episode_count", F.lit(0))), "citation_label", "first_ord")
    lists = canonical.select("canonical_key", *nested).unionByName(matched.where("canonical_key is null").select(F.col("target").alias("canonical_key"), *nested))
    return done.join(lists, "canonical_key", "left").join(citations, "canonical_key", "left")


def merge_stats(records: DataFrame) -> DataFrame:
    """Counts of matched and unmatched show-note records and of their links."""
    hit = F.col("canonical_key").isNotNull()
    return records.agg(F.count("*").alias("show_note_records"), F.count_if(hit).alias("matched_records"), F.count_if(~hit).alias("unmatched_records"), F.coalesce(F.sum("link_count"), F.lit(0)).alias("show_note_link_mentions"))


def attach_evidence_links(statements: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Statements with the links of the last sidecar row of their episode and statement key."""
    keyed = sidecar.where(F.size("evidence_links") > 0).select(F.col("episode_url").alias("_u"), text.statement_key("pearl").alias("_k"), "evidence_links", F.col("ord").alias("_so"))
    right = last_wins(keyed, ["_u", "_k"], "_so").drop("_so")
    base = statements.drop("evidence_links").withColumn("pearl_key", text.statement_key("pearl"))
    return base.join(right, base["episode_url"].eqNullSafe(right["_u"]) & (base["pearl_key"] == right["_k"]), "left").drop("_u", "_k")


def _best(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy("pearl_key", "link_key").orderBy(*order, "ord", "_i")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _rank(column: str, table: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(column)), F.lit(0))


def canonical_statements(statements: DataFrame) -> DataFrame:
    """One record per statement over all episodes: best citation and best link per publication, dense ids."""
    rows = statements.withColumn("pearl_key", text.statement_key("pearl")).where("pearl_key <> ''")
    rows = rows.withColumns({c: text.clean_text(c) for c in ("topic", "segment", "clinical_topic", "episode_title", "episode_url", "episode_date")})
    rows = together(rows, "pearl_key")
    base = rows.groupBy("pearl_key").agg(
        aggs.preferred_text("pearl").alias("pearl"), aggs.sorted_set(F.col("topic")).alias("topics"), _union("specialty_tags").alias("specialty_tags"), aggs.sorted_set(F.col("segment")).alias("segments"),
        aggs.sorted_set(F.col("clinical_topic")).alias("clinical_topics"), aggs.sorted_set(F.lower(text.clean_text("episode_category"))).alias("episode_categories"), F.min("ord").alias("first_ord"),
    )
    out = base.join(_episode_counts(rows, "pearl_key"), "pearl_key", "left").join(_episode_lists(rows, "pearl_key"), "pearl_key", "left")
    for column, count, order, show in (
        ("supporting_citations", "citation_count", lambda: [F.coalesce("item.score", F.lit(0.0)).desc()], lambda: [-F.coalesce("item.score", F.lit(0.0))]),
        ("evidence_links", "evidence_link_count", lambda: [_rank("item.support", vocab.SUPPORT_RANK).desc(), _rank("item.confidence", vocab.CONFIDENCE_RANK).desc()], lambda: [-_rank("item.support", vocab.SUPPORT_RANK), -_rank("item.confidence", vocab.CONFIDENCE_RANK)]),
    ):
        if column not in rows.columns:
            continue
        items = rows.select("pearl_key", "ord", F.posexplode(column).alias("_i", "item")).withColumn("link_key", F.nullif(F.col("item.canonical_key"), F.lit(""))).where("link_key is not null")
        best = _best(items, order())
        keys = [c.alias(f"k{i}") for i, c in enumerate(show())]
        packed = F.struct(*keys, F.coalesce("item.citation_label", F.lit("")).alias("l"), F.col("ord"), F.col("_i"), F.col("item"))
        lists = best.groupBy("pearl_key").agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["item"]).alias(column))
        out = out.join(lists, "pearl_key", "left").withColumn(column, F.coalesce(column, F.array().cast(rows.schema[column].dataType))).withColumn(count, F.size(column))
    return _ordered(_with_empty_lists(_with_counts(out)), "pearl", "first_ord")


def repair_links(statements: DataFrame, canonical: DataFrame) -> DataFrame:
    """Statements whose stale link keys are replaced: by alias, else by label or title; empty fields are filled.

    A label that several records have means the one with a URL, then of the model layer, then of most episodes.
    """
    rows = statements.select("pearl_key", F.posexplode("evidence_links").alias("_i", "link"))
    keys = canonical.select(F.col("canonical_key").alias("_known"))
    stale = rows.join(keys, F.col("link.canonical_key") == F.col("_known"), "left")
    alias = _aliases(canonical).withColumnRenamed("canonical_key", "_by_alias")
    rank = F.struct(F.col("pubmed_url").isNotNull(), F.array_contains("source_layers", "model_extraction"), "episode_count", -F.col("id"))
    labels = canonical.select("canonical_key", rank.alias("_r"), F.explode(F.array_distinct(F.array(text.key_text("citation_label"), text.key_text("paper_title")))).alias("_l")).where("_l <> ''")
    labels = labels.groupBy("_l").agg(F.max_by("canonical_key", "_r").alias("_by_label"))
    has_url = "pubmed_url" in statements.schema["evidence_links"].dataType.elementType.names
    link_url = F.col("link.pubmed_url") if has_url else F.lit(None).cast("string")
    address = urls.canonical_form(link_url)
    tried = stale.withColumn("_a", F.explode_outer(F.array_distinct(F.array(F.col("link.canonical_key"), F.concat(F.lit("url|"), address), urls.link_key(F.col("link.citation_label"), link_url)))))
    by_alias = tried.join(alias, F.col("_a") == F.col("alias"), "left").groupBy("pearl_key", "_i").agg(F.first("link").alias("link"), F.first("_known").alias("_known"), F.max("_by_alias").alias("_by_alias"))
    labelled = by_alias.withColumn("_l1", F.nullif(text.key_text(F.col("link.citation_label")), F.lit(""))).withColumn("_l2", F.nullif(text.key_text(F.col("link.paper_title")), F.lit("")))
    two = labels.withColumnsRenamed({"_l": "_m", "_by_label": "_by_title"})
    found = labelled.join(labels, F.col("_l1") == F.col("_l"), "left").join(two, F.col("_l2") == F.col("_m"), "left")
    found = found.withColumn("_new", F.when(F.col("_known").isNull(), F.coalesce("_by_alias", "_by_label", "_by_title")))
    fields = [c for c in _LINK_FIELDS if c in statements.schema["evidence_links"].dataType.elementType.names]
    source = canonical.select(F.col("canonical_key").alias("_src"), *[F.col(c).alias(f"_f_{c}") for c in fields])
    filled = found.join(source, F.col("_new") == F.col("_src"), "left")
    link = F.col("link").withField("canonical_key", F.coalesce("_new", "link.canonical_key"))
    for c in fields:
        kind = statements.schema["evidence_links"].dataType.elementType[c].dataType
        link = link.withField(c, F.coalesce(F.nullif(F.col(f"link.{c}").cast("string"), F.lit("")).cast(kind), F.col(f"_f_{c}").cast(kind)))
    lists = filled.withColumn("link", link).groupBy("pearl_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "link")), lambda a, b: a["_i"] - b["_i"]), lambda x: x["link"]).alias("evidence_links"), F.count_if(F.col("_new").isNotNull()).alias("repaired_links"))
    return statements.drop("evidence_links").join(lists, "pearl_key", "left").withColumn("evidence_links", F.coalesce("evidence_links", F.array().cast(statements.schema["evidence_links"].dataType)))


def attach_backlinks(canonical: DataFrame, statements: DataFrame) -> DataFrame:
    """Evidence with the statements that link to it, each once, sorted by text, with three episodes."""
    links = statements.select("pearl_key", "pearl", "id", F.slice("episodes", 1, 3).alias("episodes"), F.posexplode("evidence_links").alias("_i", "link"))
    once = first_wins(links.withColumn("_k", F.col("link.canonical_key")), ["_k", "pearl_key"], "_i")
    item = F.struct(F.coalesce("pearl", F.lit("")).alias("a"), F.col("id").alias("b"), F.struct("pearl_key", "pearl", "link.support", "link.confidence", "link.rationale", "episodes").alias("e"))
    lists = once.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("linked_pearls"), F.count("*").alias("linked_pearl_count"))
    return canonical.join(lists, canonical["canonical_key"] == lists["_k"], "left").drop("_k").withColumn("linked_pearl_count", F.coalesce("linked_pearl_count", F.lit(0)))


def attach_screening(canonical: DataFrame, screening: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Evidence with the non-null fields of its approved screening record, the last one of a key."""
    last = last_wins(screening, ["canonical_key"], "ord").select("canonical_key", *[F.col(c).alias(f"_s_{c}") for c in fields])
    out = canonical.join(last, "canonical_key", "left")
    for c in fields:
        new = F.nullif(F.col(f"_s_{c}"), F.lit(""))
        out = out.withColumn(c, F.coalesce(new, F.col(c)) if c in canonical.columns else new).drop(f"_s_{c}")
    return out


def attach_feedback(statements: DataFrame, feedback: DataFrame) -> DataFrame:
    """Statements with their flag counts, and links with theirs; ``feedback``: (pearl_key, canonical_key, flag_summary)."""
    own = feedback.where("canonical_key is null and flag_summary is not null").select("pearl_key", "flag_summary")
    per_link = feedback.where("canonical_key is not null and flag_summary is not null").groupBy("pearl_key").agg(F.map_from_entries(F.collect_list(F.struct("canonical_key", "flag_summary"))).alias("_flags"))
    out = statements.join(own, "pearl_key", "left").join(per_link, "pearl_key", "left")
    links = F.transform("evidence_links", lambda x: x.withField("flag_summary", F.try_element_at("_flags", x["canonical_key"])))
    return out.withColumn("evidence_links", links).drop("_flags")


def approved_feedback(rows: DataFrame) -> DataFrame:
    """(pearl_key, canonical_key, flag_summary): approved flags counted by reason."""
    link = F.when(F.col("target_type") == "link", F.col("canonical_key"))
    counted = rows.where("review_status = 'approved'").groupBy("pearl_key", link.alias("canonical_key"), "reason_code").agg(F.count("*").alias("n"))
    return counted.groupBy("pearl_key", "canonical_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason_code", "n")))).alias("flag_summary"))
