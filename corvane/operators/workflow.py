"""Work planning and per-episode analysis: what to fetch, extract, link, screen and merge next."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text, urls, vocab
from corvane.operators import aggs, joins, similarity


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


# --- planning -----------------------------------------------------------------------------------------


def newest_first(df: DataFrame, number: str, tie: str, limit: int | None = None) -> DataFrame:
    """Rows by falling number, missing numbers last."""
    out = df.orderBy(F.coalesce(number, F.lit(0)).desc(), F.col(tie))
    return out.limit(limit) if limit else out


def fetch_plan(known: DataFrame, listed: DataFrame, key: str, number: str, recent: int) -> DataFrame:
    """Listed pages to fetch, with the reason: new, recent (the newest so many) or empty (no notes yet)."""
    have = known.select(key, F.col("show_notes").alias("_notes"), F.lit(True).alias("_have"))
    ranked = listed.withColumn("_r", F.row_number().over(Window.orderBy(F.coalesce(number, F.lit(0)).desc(), key)))
    out = ranked.join(have, key, "left")
    reason = F.when(F.col("_have").isNull(), "new").when(F.col("_r") <= recent, "recent").when(~text.truthy("_notes"), "empty")
    return out.withColumn("reason", reason).where("reason is not null").drop("_r", "_notes", "_have")


def eligible_transcripts(df: DataFrame, source: str | None = None, generated: bool = False) -> DataFrame:
    """Transcripts with text, of a source if given, machine-made ones only if asked for."""
    tests = [text.truthy("text")]
    if source:
        tests.append(F.col("source") == source)
    if not generated:
        tests.append(~F.coalesce("ai_generated", F.lit(False)))
    return df.where(_all(tests))


def not_done(pool: DataFrame, state: DataFrame, key: str, states: Sequence[str] = ("completed",)) -> DataFrame:
    return joins.gap(pool, state.where(F.col("status").isin(list(states))), key)


def not_requested(pool: DataFrame, manifests: Sequence[DataFrame], key: str) -> DataFrame:
    """Pool without what any earlier batch asked for."""
    asked = reduce(DataFrame.unionByName, [m.select(key) for m in manifests])
    return joins.gap(pool, asked, key)


def linkable(statements: DataFrame, mentions: DataFrame, key: str = "episode_url") -> DataFrame:
    """Episodes with a statement and a mention that has a key."""
    return joins.restrict(statements.select(key).distinct(), mentions.where("canonical_key is not null"), key)


def coverage_gap(episodes: DataFrame, statements: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Episodes without statements, with their transcript's source: official if there is one, else the first."""
    named = transcripts.withColumn("source", F.coalesce("source", F.lit("unknown")))
    best = named.groupBy("episode_url").agg(F.max_by("source", F.struct((F.col("source") == "official").cast("int"), -F.col("ord"))).alias("transcript_source"))
    gap = joins.gap(episodes.withColumnRenamed("url", "episode_url"), statements, "episode_url").join(best, "episode_url", "left")
    return gap.withColumn("has_transcript", F.col("transcript_source").isNotNull())


def merge_candidates(base: DataFrame, candidates: DataFrame, key: str = "pearl_key") -> DataFrame:
    """Statements and the candidates that say something new in their episode, each once."""
    fresh = joins.first_wins(candidates, ["episode_url", key], "ord").join(base.select("episode_url", key), ["episode_url", key], "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def caption_index(videos: DataFrame) -> DataFrame:
    """(episode_number, video_id): the first video of each number in its title."""
    number = F.regexp_extract("title", r"#(\d{2,3})\b", 1).try_cast("int")
    return videos.withColumn("episode_number", number).where("episode_number is not null").groupBy("episode_number").agg(F.min_by("video_id", "ord").alias("video_id"))


def stale(current: DataFrame, stored: DataFrame, key: str, print_: str = "fingerprint") -> DataFrame:
    """Keys whose inputs changed since a batch was made, or are gone."""
    now = current.select(key, F.col(print_).alias("_now"))
    return stored.join(now, key, "left").where(~F.col(print_).eqNullSafe(F.col("_now"))).select(key)


def cached_inventory(listed: DataFrame, known: DataFrame, number: str = "episode_number", url: str = "url") -> DataFrame:
    """Listed episodes with the cached address of their number, where there is one, instead of the listed one."""
    cached = known.where(F.col(number).isNotNull() & text.truthy(url)).groupBy(F.col(number).alias("_n")).agg(F.min_by(url, "ord").alias("_url"))
    out = listed.join(cached, F.col(number) == F.col("_n"), "left")
    return out.withColumn(url, F.coalesce("_url", url)).drop("_n", "_url")


def captions_to_fetch(gaps: DataFrame, videos: DataFrame) -> DataFrame:
    """Episodes without a transcript and the first video of their number."""
    return gaps.join(caption_index(videos), "episode_number")


def approved_statements(candidates: DataFrame, episodes: DataFrame) -> DataFrame:
    """Approved and attributed candidates as statement rows of known episodes."""
    passed = candidates.where((F.col("review_status") == "approved") & text.truthy("reviewed_by"))
    known = episodes.select(F.col("url").alias("episode_url"), F.col("title").alias("episode_title"), F.col("date").alias("episode_date"), "episode_number")
    return passed.join(known, "episode_url").select("episode_url", "episode_title", "episode_date", "episode_number", F.col("statement").alias("pearl"), text.topic_label("topic").alias("topic"), text.statement_key("statement").alias("pearl_key"), "ord")


def by_episode(mentions: DataFrame) -> DataFrame:
    """Mentions in the order of their episodes' addresses, within one in input order."""
    return mentions.orderBy(F.col("episode_url").asc_nulls_first(), "ord")


def build_pool(transcripts: DataFrame, gaps: DataFrame, done: DataFrame, source: str | None = None, number: int | None = None, refresh: bool = False, limit: int | None = None) -> DataFrame:
    """Eligible transcripts of uncovered episodes, without those done before unless refreshed, newest first."""
    pool = joins.restrict(eligible_transcripts(transcripts, source), gaps, "episode_url")
    if number is not None:
        pool = pool.where(F.col("episode_number") == number)
    if not refresh:
        pool = joins.gap(pool, done, "episode_url")
    return newest_first(pool, "episode_number", "episode_url", limit)


def screening_pool(evidence: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Canonical records with a key that aren't screened yet, in gold order."""
    pool = joins.gap(evidence.where(text.truthy("canonical_key")), done, "canonical_key").orderBy("id")
    return pool.limit(limit) if limit else pool


def enriched(mentions: DataFrame, lines: DataFrame, line_links: DataFrame, mention_id: str) -> DataFrame:
    """Mentions with the details of the lines around their citation; what was there before is overwritten, also by null.

    ``lines``: (episode_url, line_no, context); ``line_links``: (episode_url, line_no, label, url). Mentions that aren't located keep their values.
    """
    at = locate_citations(mentions, line_links, mention_id)
    near = lines.select(F.col("episode_url").alias("_e"), F.col("line_no").alias("_at"), "context")
    out = mentions.join(at, mention_id, "left").join(near, (F.col("episode_url") == F.col("_e")) & (F.col("line_no") == F.col("_at")), "left")
    found = details("citation_label", "context", "pubmed_url")
    kept = {c: F.when(F.col("_at").isNotNull(), found[c]).otherwise(F.col(c).cast(k)) for c, k in (("nct_id", "string"), ("sample_size", "long"), ("journal", "string"))}
    return out.withColumns(kept).drop("_e", "_at", "context", "line_no")


# --- selectors ---------------------------------------------------------------------------------------


def link_selector(episode: int | None = None, url: str | None = None, key: str | None = None, contains: str | None = None, canonical_key: str | None = None, confidence: str | None = None, support: str | None = None) -> Column:
    """Condition on link rows; ``confidence="none"`` means null. Refuses an empty selection."""
    tests = []
    if episode is not None:
        tests.append(F.col("episode_number") == episode)
    if url:
        tests.append(F.col("episode_url") == url)
    if key:
        tests.append(F.col("pearl_key") == key)
    if contains:
        tests.append(F.contains(F.lower("pearl"), F.lit(contains.lower())))
    if canonical_key:
        tests.append(F.col("canonical_key") == canonical_key)
    if confidence:
        tests.append(F.col("confidence").eqNullSafe(F.lit(None if confidence == "none" else confidence)))
    if support:
        tests.append(F.col("support") == support)
    if not tests:
        raise ValueError("an empty selection would take every row")
    return F.coalesce(_all(tests), F.lit(False))


def feedback_selector(row_id: int | None = None, key: str | None = None, reason: str | None = None, contains: str | None = None) -> Column:
    """Condition on feedback rows. Refuses an empty selection."""
    tests = [F.col(c) == v for c, v in (("id", row_id), ("pearl_key", key), ("reason_code", reason)) if v is not None]
    if contains:
        tests.append(F.contains(F.lower(F.coalesce("pearl_text_snapshot", F.lit(""))), F.lit(contains.lower())))
    if not tests:
        raise ValueError("an empty selection would take every row")
    return F.coalesce(_all(tests), F.lit(False))


def statement_filter(df: DataFrame, words: str = "", specialty: str | None = None, category: str | None = None, linked: bool = False) -> DataFrame:
    """Statements by text in any of their fields, specialty, category, and whether evidence is linked; all together."""
    tests: list[Column] = []
    if linked:
        tests.append(F.coalesce("evidence_link_count", F.lit(0)) > 0)
    if specialty:
        tests.append(F.array_contains("specialty_tags", specialty))
    if category:
        tests.append(F.array_contains("episode_categories", category))
    if words.strip():
        parts = [c for c in ("pearl", "topics", "segments", "clinical_topics", "specialty_tags", "episode_categories", "episode_titles", "citation_labels") if c in df.columns]
        tests.append(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(words.strip().lower())))
    return df.where(F.coalesce(_all(tests), F.lit(False)))


def by_key(evidence: DataFrame, key: str) -> DataFrame:
    """The record of a citation that was followed."""
    return evidence.where(F.col("canonical_key") == key).orderBy("id").limit(1)


def feedback_rows(raw: DataFrame, imported_at: str) -> DataFrame:
    """Feedback as it is kept: the source's columns, pending, with the time of import."""
    source = "id submitted_at target_type pearl_key pearl_text_snapshot canonical_key reason_code comment episode_url".split()
    return raw.select(*source, F.lit("pending").alias("review_status"), F.lit(imported_at).alias("imported_at"))


# --- per-episode analysis --------------------------------------------------------------------------------


def episode_number(title: Column | str, url: Column | str, stored: Column | str) -> Column:
    """First number of up to 3 digits in the title, else in the URL, else the stored one (mentions use this rule)."""
    found = [text.nullify(F.regexp_extract(x, r"#?(\d{1,3})", 1)).try_cast("int") for x in (title, url)]
    return F.coalesce(*found, F.col(stored) if isinstance(stored, str) else stored)


def statement_urls(v: Column | str) -> Column:
    """Normalised addresses in a statement, of markdown links and bare ones."""
    v = F.col(v) if isinstance(v, str) else v
    found = F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit(r"https?://[^\s\])>\"]+"), 0)
    return F.array_distinct(F.filter(F.transform(found, urls.normalize), lambda u: u.isNotNull()))


def recover_links(mentions: DataFrame, links: DataFrame, block: str, mention_id: str) -> DataFrame:
    """Mentions without a URL get that of the best link of their block, if the match is confident.

    ``links``: (block, label, url, position).
    """
    have = text.truthy("pubmed_url")
    right = links.select(F.col(block).alias("_b"), F.col("label").alias("_label"), F.col("url").alias("_url"), F.col("position").alias("_pos"))
    pairs = mentions.where(~have).join(right, F.col(block) == F.col("_b"))
    score = similarity.recovery_score(F.col("paper_title"), F.col("citation_label"), F.col("context_topic"), F.col("_label"), F.col("_url"))
    best = pairs.withColumn("_s", score).where("_s > 0").groupBy(mention_id).agg(F.max_by(F.struct("_label", "_url", "_s", "paper_title", "citation_label"), F.struct("_s", -F.col("_pos"))).alias("m"))
    sure = best.where(similarity.confident(F.col("m.paper_title"), F.col("m.citation_label"), F.col("m._label"), F.col("m._s"))).select(mention_id, F.col("m._url").alias("_found"))
    return mentions.join(sure, mention_id, "left").withColumn("pubmed_url", F.when(have, F.col("pubmed_url")).otherwise(F.col("_found"))).drop("_found")


def locate_citations(mentions: DataFrame, line_links: DataFrame, mention_id: str) -> DataFrame:
    """(mention, line): the first line that links to the mention's URL, else the first whose label is the mention's.

    ``line_links``: (episode_url, line_no, label, url).
    """
    right = line_links.select(F.col("episode_url").alias("_e"), "line_no", text.key_text("label").alias("_label"), urls.normalize("url").alias("_u"))
    left = mentions.select(mention_id, "episode_url", urls.normalize("pubmed_url").alias("_mu"), text.nullify(text.key_text("citation_label")).alias("_ml"))
    pairs = left.join(right, F.col("episode_url") == F.col("_e"))
    at = pairs.groupBy(mention_id).agg(F.min(F.when(F.col("_mu") == F.col("_u"), F.col("line_no"))).alias("a"), F.min(F.when(F.col("_ml") == F.col("_label"), F.col("line_no"))).alias("b"))
    return left.select(mention_id).join(at, mention_id, "left").select(mention_id, F.coalesce("a", "b").alias("line_no"))


def details(label: Column | str, context: Column | str, url: Column | str) -> Column:
    """(nct_id, sample_size, journal) of a citation and the text around it."""
    both = F.concat_ws(" ", text.nullify(label), text.nullify(context))
    return F.struct(urls.nct(both).alias("nct_id"), text.largest_sample(context).alias("sample_size"), text.journal(both, url).alias("journal"))


def assign_segments(statements: DataFrame, segments: DataFrame, statement_id: str, least: float = 0.6) -> DataFrame:
    """(statement, segment_index, rule): the cited mention's segment, else the best covered one, else by position.

    ``statements``: (id, episode_url, pearl, position, cited_segment); ``segments``: (episode_url, segment_index, title).
    The i-th statement takes the i-th segment only where an episode has as many of both.
    """
    seg = segments.select(F.col("episode_url").alias("_e"), "segment_index", text.content_tokens("title").alias("_t"), F.count("*").over(Window.partitionBy("episode_url")).alias("_n"))
    pairs = statements.join(seg, F.col("episode_url") == F.col("_e")).withColumn("_c", similarity.coverage(F.col("_t"), text.content_tokens("pearl")))
    best = similarity.best_match(pairs, [statement_id], "_c", "segment_index", least).select(statement_id, F.col("segment_index").alias("_best"))
    counts = seg.groupBy(F.col("_e").alias("_k")).agg(F.first("_n").alias("_segments"))
    numbered = statements.withColumn("_i", F.row_number().over(Window.partitionBy("episode_url").orderBy("position")) - 1).withColumn("_statements", F.count("*").over(Window.partitionBy("episode_url")))
    out = numbered.join(best, statement_id, "left").join(counts, F.col("episode_url") == F.col("_k"), "left")
    by_place = F.when(F.col("_statements") == F.col("_segments"), F.col("_i"))
    rule = F.when(F.col("cited_segment").isNotNull(), "citation").when(F.col("_best").isNotNull(), "coverage").when(by_place.isNotNull(), "position")
    return out.select(statement_id, F.coalesce("cited_segment", "_best", by_place).cast("int").alias("segment_index"), rule.alias("rule"))


def clinical_topic(segment: str, heading: str, cited: str, category: str) -> Column:
    return F.coalesce(*[text.clean_text(c) for c in (segment, heading, cited, category)])


def episode_category(mentions: DataFrame, titles: DataFrame, keywords: dict[str, str] = vocab.TITLE_WORDS) -> DataFrame:
    """(episode_url, label, score, is_top, is_secondary): a vote for each tag of a mention, two for each keyword in the title."""
    tags = mentions.select("episode_url", F.posexplode("specialty_tags").alias("_p", "label"), "ord").select("episode_url", "label", F.lit(1).alias("weight"), (F.col("ord") * 64 + F.col("_p")).alias("ord"))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(c).alias("c")) for i, (w, c) in enumerate(keywords.items())])
    hit = F.filter(pairs, lambda k: F.contains(F.concat(F.lit(" "), text.key_text("title"), F.lit(" ")), F.concat(F.lit(" "), k["w"], F.lit(" "))))
    named = titles.select("episode_url", F.explode(hit).alias("k")).select("episode_url", F.col("k.c").alias("label"), F.lit(2).alias("weight"), (F.lit(1 << 60) + F.col("k.i")).alias("ord"))
    return aggs.votes(tags.unionByName(named), "episode_url", "label", "weight")


# --- model-assisted steps -------------------------------------------------------------------------------


def grounding(full_text: str, abstract: str, notes: str) -> Column:
    """(grounded_in, source text): full text, else abstract, else the show notes alone."""
    kinds = (("pmc_fulltext", full_text), ("pubmed_abstract", abstract), ("show_notes_only", notes))
    return F.coalesce(*[F.when(text.truthy(c), F.struct(F.lit(k).alias("grounded_in"), F.col(c).alias("source_text"))) for k, c in kinds])


def display_line(index: Column) -> Column:
    """One evidence line of a prompt: number, label, quoted title, (type, year, journal, n=), best summary."""
    detail = F.concat_ws(", ", text.nullify("study_type"), F.col("year").cast("string"), text.nullify("journal"), F.when(F.col("sample_size").isNotNull(), F.concat(F.lit("n="), F.col("sample_size").cast("string"))))
    best = F.coalesce(*[text.nullify(c) for c in ("clinical_bottom_line", "outcome", "brief_summary", "context_topic")])
    return F.concat_ws(" ", F.format_string("[%d]", index), text.nullify("citation_label"), F.when(text.truthy("paper_title"), F.concat(F.lit('"'), "paper_title", F.lit('"'))), F.when(detail != "", F.concat(F.lit("("), detail, F.lit(")"))), F.when(best.isNotNull(), F.concat(F.lit("- "), best)))


def prompts(statements: DataFrame, pool: DataFrame, episode: str = "episode_url") -> DataFrame:
    """(episode, prompt): numbered statements and numbered evidence of each episode."""
    number = lambda order: F.row_number().over(Window.partitionBy(episode).orderBy(order)) - 1
    said = statements.withColumn("_i", number("ord")).groupBy(episode).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.format_string("[%d] %s", "_i", "pearl").alias("t")))), lambda x: x["t"]), "\n").alias("_s"))
    cited = pool.withColumn("_i", number("ord")).withColumn("t", display_line(F.col("_i"))).groupBy(episode).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "t"))), lambda x: x["t"]), "\n").alias("_e"))
    return said.join(cited, episode).select(episode, F.concat(F.lit("STATEMENTS\n"), "_s", F.lit("\n\nEVIDENCE\n"), "_e").alias("prompt"))


def verified_links(raw: DataFrame, statements: DataFrame, pool: DataFrame, episode: str = "episode_url") -> tuple[DataFrame, DataFrame]:
    """(link rows, dropped counts): model links by number, checked against what the prompt held.

    ``raw``: (episode, pearl, trial, support, confidence, rationale, ord). Out of range, unknown support and
    repeats of a key are dropped; an unknown confidence becomes null.
    """
    number = lambda order: F.row_number().over(Window.partitionBy(episode).orderBy(order)) - 1
    s = statements.select(episode, number("ord").alias("pearl"), F.col("pearl_key"), F.col("pearl").alias("pearl_text"))
    e = pool.select(episode, number("ord").alias("trial"), "canonical_key", "citation_label")
    known = raw.join(s, [episode, "pearl"]).join(e, [episode, "trial"]).where(F.col("support").isin(list(vocab.SUPPORT_RANK)))
    known = known.withColumn("confidence", F.when(F.col("confidence").isin(list(vocab.CONFIDENCE_RANK)), F.col("confidence")))
    kept = joins.first_wins(known, [episode, "pearl_key", "canonical_key"], "ord").select(episode, "pearl_key", F.col("pearl_text").alias("pearl"), "canonical_key", "citation_label", "support", "confidence", "rationale", "ord")
    dropped = raw.groupBy(episode).agg(F.count("*").alias("_all")).join(kept.groupBy(episode).agg(F.count("*").alias("_kept")), episode, "left")
    return kept, dropped.select(episode, (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias("dropped"))


def link_records(kept: DataFrame, episode: str = "episode_url") -> DataFrame:
    """One pending record for each statement that has a verified link."""
    link = F.struct("ord", F.struct("canonical_key", "citation_label", "support", "confidence", "rationale").alias("l"))
    return kept.groupBy(episode, "pearl_key", "pearl").agg(F.transform(F.array_sort(F.collect_list(link)), lambda x: x["l"]).alias("links")).withColumn("review_status", F.lit("pending"))


def screening_record(df: DataFrame, fields: Sequence[str], confidences: Sequence[str] = ("high", "medium", "low")) -> DataFrame:
    """Clean screening rows, pending; an unknown confidence becomes null."""
    return df.select("canonical_key", *[text.clean_text(c).alias(c) for c in fields], F.when(F.col("confidence").isin(list(confidences)), F.col("confidence")).alias("confidence"), F.lit("pending").alias("review_status"))


def baseline_coverage(model: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Statements that the model links, the token baseline links, both, either alone, none."""
    m, b = model.select(key).distinct().withColumn("m", F.lit(True)), baseline.select(key, (F.size("supporting_citations") > 0).alias("b"))
    out = b.join(m, key, "left").withColumn("m", F.coalesce("m", F.lit(False)))
    return out.agg(*[F.count_if(c).alias(n) for n, c in (("model", F.col("m")), ("baseline", F.col("b")), ("both", F.col("m") & F.col("b")), ("model_only", F.col("m") & ~F.col("b")), ("baseline_only", ~F.col("m") & F.col("b")), ("neither", ~F.col("m") & ~F.col("b")))])
