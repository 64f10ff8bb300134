"""Queries that bring the driver's tables into the shape of mentions, episodes and statements and run the record operators on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text, urls
from corvane.functions.urls import LIBRARY
from corvane.operators import canonical, joins, repair, reports, validate, workflow
from corvane.plans.base import Catalog
from corvane.plans.text_queries import key
from corvane.sources import files, markup

catalog = Catalog()
query = catalog.query


def _mentions(t):
    """A mention for each line of an order: the part is the publication, the order the episode."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    null = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        F.col("p_name").alias("citation_label"), F.concat_ws(" ", "p_name", "p_type").alias("paper_title"), F.concat(F.lit("http://doi.org/10.1000/P"), "l_partkey").alias("pubmed_url"),
        F.expr("cast(1990 + p_size % 30 as string)").alias("year"), F.col("p_type").alias("brief_summary"), F.concat(F.lit(" "), "l_returnflag", F.lit("  topic")).alias("context_topic"),
        F.expr("case l_linestatus when 'O' then 'RCT' else 'other' end").alias("study_type"), F.expr("if(l_discount > 0.05, array('cardiology', 'Cardiology ', 'none'), array())").alias("specialty_tags"),
        F.col("l_linestatus").alias("segment"), null("string").alias("nct_id"), F.col("p_size").alias("sample_size"), F.lit("n/a").alias("journal"), F.col("l_returnflag").alias("episode_category"),
        F.col("l_orderkey").cast("int").alias("episode_number"), F.concat(F.lit("Order "), "l_orderkey").alias("episode_title"), F.concat(F.lit("https://e.org/"), "l_orderkey").alias("episode_url"),
        null("string").alias("episode_date"), F.expr("((l_orderkey * 10 + l_linenumber) * 4 + instr('ANR', l_returnflag)) * 2 + if(l_linestatus = 'O', 1, 0)").alias("ord"),
    )


_M = """m as (select 'doi|10.1000/p' || l_partkey as canonical_key, p_name as citation_label, p_name || ' ' || p_type as paper_title, (1990 + p_size % 30)::int as year, l_returnflag || ' topic' as context_topic,
    case l_linestatus when 'O' then 'RCT' else 'other' end as study_type, l_discount > 0.05 as tagged, l_linestatus as segment, nullif(p_size, 0) as sample_size, l_orderkey, ((l_orderkey * 10 + l_linenumber) * 4 + strpos('ANR', l_returnflag)) * 2 + (l_linestatus = 'O')::int as ord
    from lineitem join part on l_partkey = p_partkey)"""


@query(f"""
    with {_M}, s as (select canonical_key, study_type, count(*) n, min(ord) o from m group by all), c as (select canonical_key, array_agg(study_type order by n desc, o)[1] as study_type from s group by 1),
    g as (select canonical_key, min(citation_label) as citation_label, min(paper_title) as paper_title, min(year) as year, min(sample_size) as sample_size, array_agg(context_topic order by length(context_topic) desc, ord)[1] as context_topic,
        count(*)::bigint as mention_count, count(distinct l_orderkey)::int as episode_count, max(l_orderkey)::int as latest_episode_number, case when bool_or(tagged) then 'cardiology' else '' end as tags,
        array_to_string(list_sort(list_distinct(array_agg(segment))), '|') as segments, min(ord) as o from m group by 1)
    select g.* exclude (o), study_type, 'https://doi.org/10.1000/P' || split_part(canonical_key, '/p', 2) as pubmed_url, (row_number() over (order by latest_episode_number desc, citation_label, o) - 1)::bigint as id from g join c using (canonical_key)""")
def canonical_evidence(t):
    out = canonical.canonical_evidence(_mentions(t))
    return out.select("canonical_key", "citation_label", "paper_title", "year", "sample_size", "context_topic", "mention_count", "episode_count", "latest_episode_number", F.array_join("specialty_tags", "|").alias("tags"), F.array_join("segments", "|").alias("segments"), "study_type", "pubmed_url", "id")


@query(f"""
    with {_M} select 'https://e.org/' || l_orderkey as episode_url, canonical_key, count(*)::bigint as mentions, array_agg(context_topic order by length(context_topic) desc, ord)[1] as context_topic, min(year) as year,
        case when bool_or(tagged) then 'cardiology' else '' end as tags from m group by 1, 2""")
def episode_mentions(t):
    return canonical.dedupe_mentions(_mentions(t)).select("episode_url", "canonical_key", "mentions", "context_topic", "year", F.array_join("specialty_tags", "|").alias("tags"))


def _episodes(t):
    """An episode for each order; its notes link to the customer's page and to an article."""
    note = F.concat(F.lit("see [Paper "), "o_custkey", F.lit("](http://www.nature.com/articles/"), "o_custkey", F.lit("/?x=1) and [shop](https://www.amazon.com/x) or [Paper "), F.expr("o_custkey % 7"), F.lit(f"](https://pubmed.{LIBRARY}/"), F.expr("1000 + o_custkey % 7"), F.lit("/)"))
    return t.orders.select(F.concat(F.lit("https://e.org/"), "o_orderkey").alias("url"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("date"), F.col("o_orderkey").cast("int").alias("episode_number"), note.alias("show_notes"), F.col("o_orderkey").alias("ord"))


_L = f"""l as (select o_orderkey, 'Paper ' || o_custkey as label, 'https://nature.com/articles/' || o_custkey as url, 'url|https://nature.com/articles/' || o_custkey as evidence_key from orders
    union all select o_orderkey, 'Paper ' || o_custkey % 7, 'https://pubmed.{LIBRARY}/' || (1000 + o_custkey % 7), 'pmid|' || (1000 + o_custkey % 7) from orders)"""


@query(f"""
    with {_L} select evidence_key, min(label) as citation_label, min(url) as url, count(*)::bigint as link_count, count(distinct o_orderkey)::int as episode_count, max(o_orderkey)::int as latest_episode_number from l group by 1""")
def show_note_evidence(t):
    return canonical.show_note_evidence(canonical.show_note_links(_episodes(t))).select("evidence_key", "citation_label", "url", "link_count", "episode_count", "latest_episode_number")


@query(f"""
    with {_L}, e as (select evidence_key, min(label) as label, count(*)::bigint as links, count(distinct o_orderkey)::bigint as episodes, min(url) as url from l group by 1),
    k as (select 'pmid|' || (1000 + n) as canonical_key from range(3) r(n))
    select coalesce(k.canonical_key, 'show_note|' || evidence_key) as canonical_key, case when k.canonical_key is null then links else 1 end::bigint as show_note_link_count, case when k.canonical_key is null then episodes else 1 end::bigint as show_note_episode_count,
        case when k.canonical_key is null then 'show_notes_links' else 'model_extraction|show_notes_links' end as layers from e left join k on evidence_key = canonical_key""")
def merge_show_notes(t):
    # three of the articles are known, under another label
    known = t.spark.range(3).select(
        F.concat(F.lit(f"https://www.{LIBRARY}/pubmed/"), (F.col("id") + 1000).cast("string")).alias("pubmed_url"), F.concat(F.lit("Known "), "id").alias("citation_label"), F.col("id").alias("ord"), F.lit("https://e.org/0").alias("episode_url"),
        *[F.lit(None).cast("string").alias(c) for c in ("paper_title", "year", "brief_summary", "context_topic", "study_type", "segment", "nct_id", "journal", "episode_category", "episode_title", "episode_date")],
        F.array().cast("array<string>").alias("specialty_tags"), F.lit(None).cast("int").alias("sample_size"), F.lit(1).alias("episode_number"),
    )
    evidence, links = canonical.canonical_evidence(known), canonical.show_note_links(_episodes(t))
    out = canonical.merge_show_notes(evidence, canonical.show_note_evidence(links), links)
    return out.select("canonical_key", F.col("show_note_link_count").cast("long").alias("show_note_link_count"), F.col("show_note_episode_count").cast("long").alias("show_note_episode_count"), F.array_join("source_layers", "|").alias("layers"))


_LINK = "array<struct<canonical_key:string,citation_label:string,paper_title:string,support:string,confidence:string,rationale:string>>"


def _statements(t):
    """A statement for each status and priority of a customer's orders, with a link for each order."""
    link = F.struct(F.concat(F.lit("k|"), F.expr("o_custkey % 50")).alias("canonical_key"), F.lit(None).cast("string").alias("citation_label"), F.lit(None).cast("string").alias("paper_title"), F.expr("if(o_orderkey % 2 = 0, 'direct', 'background')").alias("support"), F.expr("if(o_orderkey % 3 = 0, 'high', null)").alias("confidence"), F.col("o_orderkey").cast("string").alias("rationale"))
    pearl = F.concat(F.lit("Treat "), F.col("o_custkey").cast("string"), F.lit(" as "), "o_orderpriority", F.expr("if(o_orderkey % 2 = 0, ' (Doe 2020)', '')"))
    return t.orders.select(
        pearl.alias("pearl"), F.concat(F.lit("- "), "o_orderstatus", F.lit(" /")).alias("topic"), F.array().cast("array<string>").alias("specialty_tags"), F.lit(None).cast("string").alias("segment"), F.lit(None).cast("string").alias("clinical_topic"), F.lit("Cat").alias("episode_category"),
        F.col("o_orderkey").cast("int").alias("episode_number"), F.lit("t").alias("episode_title"), F.concat(F.lit("https://e.org/"), "o_orderkey").alias("episode_url"), F.lit(None).cast("string").alias("episode_date"), F.col("o_orderkey").alias("ord"), F.array(link).cast(_LINK).alias("evidence_links"),
    )


_S = f"s as (select {key("'Treat ' || o_custkey || ' as ' || o_orderpriority")} as pearl_key, o_orderkey, o_custkey, o_orderstatus, 'Treat ' || o_custkey || ' as ' || o_orderpriority || case when o_orderkey % 2 = 0 then ' (Doe 2020)' else '' end as pearl from orders)"


@query(f"""
    with {_S}, g as (select pearl_key, count(distinct o_orderkey)::int as episode_count, max(o_orderkey)::int as latest_episode_number, min(o_orderkey) as o,
        array_agg(o_orderkey order by o_orderkey % 2, o_orderkey % 3 <> 0, o_orderkey)[1]::varchar as best_link from s group by 1)
    select pearl_key, episode_count, latest_episode_number, 1 as evidence_link_count, best_link from g""")
def canonical_statements(t):
    out = canonical.canonical_statements(_statements(t))
    return out.select("pearl_key", "episode_count", "latest_episode_number", "evidence_link_count", F.element_at("evidence_links", 1)["rationale"].alias("best_link"))


@query("""
    select p_partkey::varchar as pearl_key, case when p_partkey % 4 < 2 then 'k|' || p_partkey when p_partkey % 4 = 2 then 'k|' || p_partkey else 'gone|' || p_partkey end as canonical_key, (p_partkey % 4 = 2)::int::bigint as repaired_links from part""")
def repair_links(t):
    label = F.concat(F.lit("Part No. "), F.col("p_partkey").cast("string"))
    records = t.part.select(F.concat(F.lit("k|"), "p_partkey").alias("canonical_key"), F.col("p_partkey").alias("id"), label.alias("citation_label"), F.lit(None).cast("string").alias("paper_title"), F.lit(None).cast("string").alias("pubmed_url"), F.lit(None).cast("string").alias("nct_id"), F.array(F.lit("model_extraction")).alias("source_layers"), F.lit(1).alias("episode_count"))
    records = records.withColumns({c: F.lit(None).cast(k) for c, k in (("journal", "string"), ("sample_size", "long"), ("study_type", "string"), ("year", "int"))})
    link = F.struct(F.expr("concat(if(p_partkey % 4 < 2, 'k|', 'gone|'), p_partkey)").alias("canonical_key"), F.expr("if(p_partkey % 4 = 2, concat('part no ', p_partkey, '!'), 'nobody knows')").alias("citation_label"), F.lit(None).cast("string").alias("paper_title"))
    said = t.part.select(F.col("p_partkey").cast("string").alias("pearl_key"), F.array(link).alias("evidence_links"))
    return canonical.repair_links(said, records).select("pearl_key", F.col("evidence_links")[0]["canonical_key"].alias("canonical_key"), "repaired_links")


@query(f"""
    with {_S}, g as (select pearl_key, array_agg(pearl order by length(pearl) desc, o_orderkey)[1] as pearl, min(o_custkey) % 50 as k from s group by 1)
    select 'k|' || n as canonical_key, count(pearl_key)::bigint as linked_pearl_count, (array_agg(pearl order by pearl) filter (pearl is not null))[1] as first_pearl from range(60) r(n) left join g on k = n group by n""")
def attach_backlinks(t):
    records = t.spark.range(60).select(F.concat(F.lit("k|"), "id").alias("canonical_key"))
    out = canonical.attach_backlinks(records, canonical.canonical_statements(_statements(t)))
    return out.select("canonical_key", "linked_pearl_count", F.try_element_at("linked_pearls", F.lit(1))["pearl"].alias("first_pearl"))


@query("""
    select doc_id::varchar as canonical_key, case when labels.doc_id % 2 = 0 then 'toxic ' || toxic when labels.doc_id is not null then 'quality ' || quality else 'before' end as outcome from documents left join labels using (doc_id)""")
def attach_screening(t):
    records = t.documents.select(F.col("doc_id").cast("string").alias("canonical_key"), F.lit("before").alias("outcome"))
    row = lambda c, plus: t.labels.select(F.col("doc_id").cast("string").alias("canonical_key"), F.concat(F.lit(f"{c} "), c).alias("outcome"), (F.col("doc_id") + plus).alias("ord"))
    later = row("toxic", 1_000_000_000).where("cast(canonical_key as long) % 2 = 0")
    return canonical.attach_screening(records, row("quality", 0).unionByName(later), ["outcome"])


@query("""
    with f as (select user_id, event_type, case when event_id % 3 = 0 then 'c' || event_id % 4 end as k, count(*)::bigint as n from events where event_id % 2 = 0 group by all)
    select u.user_id::varchar as pearl_key, coalesce((select n from f where f.user_id = u.user_id and k is null and event_type = 'click'), 0)::bigint as clicks, (select n from f where f.user_id = u.user_id and k = 'c2' and event_type = 'view')::bigint as views_of_c2 from (select distinct user_id from events) u""")
def attach_feedback(t):
    rows = t.events.select(F.col("user_id").cast("string").alias("pearl_key"), F.expr("if(event_id % 3 = 0, 'link', 'pearl')").alias("target_type"), F.expr("concat('c', event_id % 4)").alias("canonical_key"), F.col("event_type").alias("reason_code"), F.expr("if(event_id % 2 = 0, 'approved', 'pending')").alias("review_status"))
    said = t.events.select(F.col("user_id").cast("string").alias("pearl_key")).distinct().withColumn("evidence_links", F.array(F.struct(F.lit("c2").alias("canonical_key"))))
    out = canonical.attach_feedback(said, canonical.approved_feedback(rows))
    return out.select("pearl_key", F.coalesce(F.try_element_at("flag_summary", F.lit("click")), F.lit(0)).alias("clicks"), F.try_element_at(F.col("evidence_links")[0]["flag_summary"], F.lit("view")).alias("views_of_c2"))


@query("""
    select lang as episode_url, case when count_if(source = 'src3') > 0 then 'official' else array_agg(source order by doc_id)[1] end as transcript_source, true as has_transcript from documents where lang <> 'en' group by 1 union all select 'none', null, false""")
def transcript_gaps(t):
    seen = t.documents.select(F.col("lang").alias("episode_url"), F.expr("if(source = 'src3', 'official', source)").alias("source"), F.col("doc_id").alias("ord"))
    episodes = seen.select(F.col("episode_url").alias("url")).distinct().unionByName(t.spark.sql("select 'none' as url"))
    return workflow.coverage_gap(episodes, t.spark.sql("select 'en' as episode_url"), seen).select("episode_url", "transcript_source", "has_transcript")


@query("select 'ids name one thing' as rule, count(*)::bigint as violations from (select p_brand, p_type from part group by all having count(distinct p_name) >= 3)")
def colliding_identities(t):
    return validate.collisions(t.part.withColumn("k", F.concat_ws("|", "p_brand", "p_type")), "k", "p_name", 3, "ids name one thing")


@query("select event_id, user_id, event_type, (select max(event_id) from (select event_id from events where event_id > 100 order by event_id limit 500)) as cursor from events where event_id > 100 order by event_id limit 500")
def feedback_page(t):
    rows, cursor = files.read_cursor(t.events.select("event_id", "user_id", "event_type"), "event_id", 100)
    return rows.crossJoin(F.broadcast(cursor))


@query("""
    select l_orderkey, count(*)::bigint as expected, count_if(l_linenumber < 5)::bigint as received, count_if(l_linenumber = 5)::bigint as errors, case when count(*) = count_if(l_linenumber < 5) then 'completed' else 'failed' end as status from lineitem group by 1""")
def batch_states(t):
    results = t.lineitem.where("l_linenumber <= 5").select("l_orderkey", F.expr("if(l_linenumber < 5, 'r', null)").alias("reply"))
    return files.completeness(results, t.lineitem.select("l_orderkey"), "l_orderkey")


# --- reports and repairs ---------------------------------------------------------------------------------


@query("""
    select facet, value, count(*)::bigint as n from (select doc_id, 'lang' as facet, lang as value from documents union all select distinct doc_id, 'word', trim(x) from (select doc_id, unnest([source, lang, source]) as x from documents)) where value <> '' group by all""")
def facet_report(t):
    return reports.facet_counts(t.documents.select(F.concat(F.lit(" "), "lang").alias("lang"), F.array("source", F.concat("lang", F.lit(" ")), "source", F.lit(" ")).alias("words")), {"lang": "lang", "word": "words"})


def _evidence(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    episode = F.struct(F.when(F.col("source") != "src1", F.col("source")).alias("episode_url"))
    return joined.select("doc_id", F.col("n_chars").alias("mention_count"), F.expr("if(quality is null, '', 'u')").alias("pubmed_url"), F.col("toxic").alias("linked_pearl_count"), F.array(episode).alias("episodes"), F.array(F.col("lang"), F.col("source")).alias("specialty_tags"), F.nullif("lang", F.lit("de")).alias("study_type"))


@query("""
    select count(*)::bigint as records, sum(n_chars)::bigint as mentions, count(distinct nullif(source, 'src1'))::bigint as episodes, count_if(quality is not null)::bigint as with_link, count_if(toxic > 0)::bigint as with_statements from documents left join labels using (doc_id)""")
def hero_report(t):
    return reports.hero_stats(_evidence(t))


@query("""
    select 'total' as kind, 'records' as value, count(*)::bigint as n from documents union all select 'total', 'mentions', sum(n_chars)::bigint from documents union all select 'total', 'episodes', count(distinct nullif(source, 'src1'))::bigint from documents
    union all select 'study type', coalesce(nullif(lang, 'de'), 'other'), count(*)::bigint from documents group by 2
    union all (select 'specialty', value, count(*)::bigint as n from (select unnest([lang, source]) as value from documents) group by 2 order by n desc, value limit 8)""")
def build_report(t):
    return reports.build_stats(_evidence(t))


@query("""
    select 'text' as field, count_if(coalesce(text, '') <> '')::bigint as filled, count(*)::bigint as total, round_even(100.0 * count_if(coalesce(text, '') <> '') / count(*), 1)::double as percent from documents
    union all select 'label', count_if(quality is not null)::bigint, count(*)::bigint, round_even(100.0 * count_if(quality is not null) / count(*), 1)::double from documents left join labels using (doc_id)""")
def filled_fields(t):
    return reports.coverage(t.documents.join(t.labels, "doc_id", "left"), {"text": text.truthy("text"), "label": F.col("quality").isNotNull()})


@query("select (o_orderkey - o_orderkey % 100)::bigint as bucket, count(*)::bigint as n from orders group by 1")
def hundreds_report(t):
    return reports.hundreds(t.orders, "o_orderkey")


@query("""
    select 'quality' as field, quality::varchar as value, count(*)::bigint as n from labels group by 2 union all select 'grade', coalesce(nullif(case when toxic = 1 then 'toxic' else '' end, ''), '(none)'), count(*)::bigint from labels group by 2""")
def state_report(t):
    return reports.states(t.labels.withColumn("grade", F.expr("if(toxic = 1, 'toxic', '')")), ["quality", "grade"])


@query("select * from (select word as value, count(distinct p_partkey)::bigint as n from (select p_partkey, unnest(string_split(p_name, ' ')) as word from part) group by 1) order by n desc, value limit 12")
def topic_report(t):
    return reports.top_values(t.part.withColumn("w", F.split("p_name", " ")), "w", 12)


@query("select count(*)::bigint as total, count_if(quality = 1)::bigint as succeeded, count_if(quality = 0)::bigint as failed, array_to_string(list_sort(array_agg(doc_id) filter (quality = 0)), '|') as failed_keys from labels")
def run_report(t):
    out = reports.run_counters(t.labels.select("doc_id", (F.col("quality") == 1).alias("ok")), "doc_id")
    return out.withColumn("failed_keys", F.array_join("failed_keys", "|"))


@query(f"""
    select p_partkey, case p_partkey % 7 when 0 then null when 1 then '' when 2 then null when 3 then null when 4 then null when 5 then 'https://pubmed.{LIBRARY}/12345' else 'https://a.org/x' end as url from part""")
def dead_urls(t):
    home = f"https://pubmed.{LIBRARY}"
    raw = F.expr(f"case p_partkey % 7 when 0 then null when 1 then '' when 2 then ' {home}/' when 3 then 'Null' when 4 then 'http://localhost/x' when 5 then '{home}/12345' else 'https://a.org/x' end")
    return urls.clear_dead(t.part.select("p_partkey", raw.alias("url")), "url")


@query("""
    select doc_id, case when quality = 1 and (toxic = 1 or doc_id % 2 = 0) then 'auto_triaged' when quality = 1 then 'approved' else 'pending' end as review_status, case when quality = 1 and (toxic = 1 or doc_id % 2 = 0) then 'day' end as triaged_at,
        case when not (quality = 1 and (toxic = 1 or doc_id % 2 = 0)) then 'day' end as reviewed_at from labels""")
def downgrade_states(t):
    rows = t.labels.select("doc_id", F.expr("if(quality = 1, 'approved', 'pending')").alias("review_status"), F.expr("if(toxic = 1, 'Auto-Clear of the batch', null)").alias("review_note"), F.expr("if(doc_id % 2 = 0, '', 'r')").alias("reviewed_by"), F.lit("day").alias("reviewed_at"))
    return repair.downgrade_unattributed(rows).select("doc_id", "review_status", "triaged_at", "reviewed_at")


@query(f"""
    with p as (select distinct l_orderkey, {key('p_name')} as name, p_partkey from lineitem join part on l_partkey = p_partkey), n as (select l_orderkey, name, count(distinct p_partkey) as many, min(p_partkey) as k from p group by all)
    select l_orderkey * 1000000 + p_partkey as link, case when many = 1 then 'k|' || k else 'stale' end as canonical_key, many = 1 as repaired from p join n using (l_orderkey, name)""")
def repair_by_name(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey").distinct().join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("episode_url", F.col("l_orderkey").cast("string"))
    known = rows.select("episode_url", F.concat(F.lit("k|"), "p_partkey").alias("canonical_key"), F.col("p_name").alias("citation_label"), F.lit(None).cast("string").alias("paper_title"))
    links = rows.select((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("link"), "episode_url", F.lit("stale").alias("canonical_key"), F.upper("p_name").alias("citation_label"), F.lit("").alias("paper_title"))
    return repair.repair_by_name(links, known, "link").select("link", "canonical_key", "repaired")


@query("""
    select c_custkey, case c_custkey % 4 when 0 then 'k|' || c_custkey when 1 then 'pmid|' || c_custkey when 2 then 'label|' || c_custkey else 'stale' end as canonical_key, c_custkey % 4 in (1, 2) as repaired from customer""")
def repair_screening(t):
    c = t.customer
    screened = c.select("c_custkey", F.expr("if(c_custkey % 4 = 0, concat('k|', c_custkey), 'stale')").alias("canonical_key"), F.expr("if(c_custkey % 4 = 1, c_custkey, null)").alias("pmid"), F.expr("if(c_custkey % 4 = 2, upper(c_name), 'twice')").alias("citation_label"))
    known = c.select(F.expr("concat(element_at(array('k|', 'pmid|', 'label|', 'other|'), cast(c_custkey % 4 + 1 as int)), c_custkey)").alias("canonical_key"), F.expr("if(c_custkey % 4 = 2, c_name, 'twice')").alias("citation_label"))
    return repair.repair_screening(screened, known).select("c_custkey", "canonical_key", "repaired")


@query("select p_partkey, case when p_partkey % 3 = 0 then 200 + p_partkey % 50 when p_partkey % 3 = 1 then null else p_partkey end::bigint as sample, case p_partkey % 4 when 0 then null when 1 then 'hearts' when 2 then null else 'Heart Failure' end as topic from part")
def sizes_and_topics(t):
    said = F.expr("case when p_partkey % 3 = 0 then concat('about ', 200 + p_partkey % 50, ' people') when p_partkey % 3 = 1 then 'none, -' else cast(p_partkey as string) end")
    topic = F.expr("case p_partkey % 4 when 0 then 'Dr. Smith''s' when 1 then '- hearts /' when 2 then ' , ' else 'Heart  Failure' end")
    whole = F.when(F.col("p_partkey") % 3 == 2, text.sample_size("p_partkey")).otherwise(F.coalesce(text.sample_size(said), text.sample_size(-F.col("p_partkey"))))
    return t.part.select("p_partkey", whole.alias("sample"), text.topic_label(topic).alias("topic"))


@query("select page_id, case page_id % 4 when 0 then '[' || page_id || ']' when 1 then '[]' end as value, case page_id % 4 when 2 then 'no complete JSON in the reply' when 3 then 'empty reply' end as error from pages")
def reply_errors(t):
    raw = F.expr("case page_id % 4 when 0 then concat('<think>x</think>Sure: [', page_id, '] done') when 1 then '```json\n[]\n```' when 2 then concat('[{\"a\": ', page_id) else ' ' end")
    return markup.parse_replies(t.pages.select("page_id", raw.alias("reply")), "page_id", "reply")


@query("select conv_id, turn, 'a ' || turn || ' & b' as line from conversations where role = 'user'")
def caption_lines(t):
    cue = F.concat(F.lit("WEBVTT\n\n00:01.000 --> 00:02.000\n<c>>> a "), F.col("turn").cast("string"), F.lit("</c> &amp; b\n\n7\n& b\n"))
    said = t.conversations.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), cue.alias("vtt"))
    return markup.captions(said, "vtt", "k").select(F.floor(F.col("k") / 1000).cast("long").alias("conv_id"), (F.col("k") % 1000).alias("turn"), "line")
