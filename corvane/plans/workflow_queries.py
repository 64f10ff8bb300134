"""Queries over work planning and model-assisted steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import workflow
from corvane.plans.base import Catalog

catalog = Catalog()
query = catalog.query


@query("select doc_id from documents where source = 'src3' and doc_id % 7 <> 0 and coalesce(text, '') <> ''")
def eligible_transcripts(t):
    shaped = t.documents.select("doc_id", "text", "source", (F.col("doc_id") % 7 == 0).alias("ai_generated"))
    return workflow.eligible_transcripts(shaped, "src3").select("doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1) and doc_id not in (select doc_id from labels where toxic = 1)")
def batch_selection(t):
    return workflow.not_requested(t.documents.select("doc_id"), [t.labels.where("quality = 1"), t.labels.where("toxic = 1")], "doc_id")


@query("""
    with b as (select o_custkey as episode_url, o_orderpriority as pearl_key, o_orderkey as ord from orders where o_orderkey % 2 = 0), c as (select o_custkey, o_orderpriority, o_orderkey from orders where o_orderkey % 2 = 1)
    select * from b union all select o_custkey, o_orderpriority, min(o_orderkey) from c where not exists (select 1 from b where episode_url = o_custkey and pearl_key = o_orderpriority) group by 1, 2""")
def candidate_merge(t):
    rows = t.orders.select(F.col("o_custkey").alias("episode_url"), F.col("o_orderpriority").alias("pearl_key"), F.col("o_orderkey").alias("ord"))
    return workflow.merge_candidates(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1"))


@query("""
    select page_id, case when page_id % 3 = 0 then 'pmc_fulltext' when page_id % 3 = 1 then 'pubmed_abstract' when page_id % 2 = 0 then 'show_notes_only' end as grounded_in from pages""")
def grounding_cascade(t):
    shaped = t.pages.select("page_id", F.expr("if(page_id % 3 = 0, html, '')").alias("full"), F.expr("if(page_id % 3 < 2, url, null)").alias("abstract"), F.expr("if(page_id % 2 = 0, url, '')").alias("notes"))
    return shaped.select("page_id", workflow.grounding("full", "abstract", "notes")["grounded_in"].alias("grounded_in"))


@query("""
    select p_partkey, case when p_partkey % 2 = 0 then 'NCT' || lpad(p_partkey::varchar, 8, '0') end as nct_id, case when p_partkey % 3 > 0 then (p_partkey % 3 * 1000 + 11) end::bigint as sample_size, case when p_partkey % 5 = 0 then 'JAMA' end as journal from part""")
def detail_parse(t):
    label = F.concat("p_name", F.expr("if(p_partkey % 2 = 0, concat(' (nct', lpad(p_partkey, 8, '0'), ')'), '')"))
    context = F.concat(F.lit("A study, N = 11; "), F.expr("if(p_partkey % 3 > 0, concat('n=', p_partkey % 3, ',011'), 'nothing')"), F.expr("if(p_partkey % 5 = 0, ' in JAMA', '')"))
    context = F.when(F.col("p_partkey") % 3 > 0, context).otherwise(F.expr("if(p_partkey % 5 = 0, 'in JAMA', 'nothing')"))
    return t.part.select("p_partkey", workflow.details(label, context, F.lit(None).cast("string")).alias("d")).select("p_partkey", "d.nct_id", "d.sample_size", "d.journal")


@query("""
    with u as (select conv_id, turn, text, (row_number() over (partition by conv_id order by turn) - 1)::int as i, count(*) over (partition by conv_id) as n from conversations where role = 'user'),
    a as (select conv_id, count(*) as m from conversations where role = 'assistant' group by 1)
    select u.conv_id * 1000 + turn as statement_id, case when turn % 5 = 0 then 7 when n = m then i end::int as segment_index, case when turn % 5 = 0 then 'citation' when n = m then 'position' end as rule from u left join a using (conv_id)""")
def segment_cascade(t):
    c = t.conversations
    said = c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("statement_id"), F.col("conv_id").alias("episode_url"), F.lit("no shared words").alias("pearl"), F.col("turn").alias("position"), F.expr("if(turn % 5 = 0, 7, null)").alias("cited_segment"))
    toc = c.where("role = 'assistant'").select(F.col("conv_id").alias("episode_url"), F.expr("cast(row_number() over (partition by conv_id order by turn) - 1 as int)").alias("segment_index"), F.lit("zzzz qqqq").alias("title"))
    return workflow.assign_segments(said, toc, "statement_id")


@query("""
    select count_if(m)::bigint as model, count_if(b)::bigint as baseline, count_if(m and b)::bigint as both, count_if(m and not b)::bigint as model_only, count_if(b and not m)::bigint as baseline_only, count_if(not m and not b)::bigint as neither
    from (select doc_id in (select doc_id from labels) as m, doc_id % 3 = 0 as b from documents)""")
def baseline_coverage(t):
    base = t.documents.select("doc_id", F.expr("if(doc_id % 3 = 0, array(1), array())").alias("supporting_citations"))
    return workflow.baseline_coverage(t.labels, base, "doc_id")
