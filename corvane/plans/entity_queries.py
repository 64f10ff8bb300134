"""Queries over entity resolution: merges, roll-ups, canonical records, votes, facets, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import aggs
from corvane.plans.base import Catalog
from corvane.plans.text_queries import key

catalog = Catalog()
query = catalog.query


@query("select p_brand, array_agg(p_name order by length(p_name) desc, p_partkey)[1] as name from part group by p_brand")
def preferred_text(t):
    return t.part.groupBy("p_brand").agg(aggs.preferred_text("p_name", "p_partkey").alias("name"))


@query("""
    with c as (select o_custkey, o_orderpriority v, count(*) n, min(o_orderkey) o from orders group by all),
    s as (select o_custkey, o_orderstatus v, count(*) n, min(o_orderkey) o from orders group by all)
    select a.o_custkey, a.v as o_orderpriority, b.v as o_orderstatus from (select o_custkey, array_agg(v order by n desc, o)[1] v from c group by 1) a
    join (select o_custkey, array_agg(v order by n desc, o)[1] v from s group by 1) b using (o_custkey)""")
def most_common(t):
    return aggs.first_seen_modes(t.orders, ["o_custkey"], ["o_orderpriority", "o_orderstatus"], "o_orderkey")


@query("""
    with m as (select p_name, array_agg(p_type order by length(p_type) desc, p_partkey)[1] as p_type, min(p_partkey) as first_ord, count(*)::bigint as mentions from part group by 1),
    b as (select p_name, p_brand v, count(*) n, min(p_partkey) o from part group by all), z as (select p_name, p_size v, count(*) n, min(p_partkey) o from part group by all)
    select m.*, (select array_agg(v order by n desc, o)[1] from b where b.p_name = m.p_name) as p_brand, (select array_agg(v order by n desc, o)[1] from z where z.p_name = m.p_name) as p_size from m""")
def merge_records(t):
    return aggs.merge_records(t.part, "p_name", ["p_type"], ["p_brand", "p_size"], "p_partkey")


_DOC_KEY = key("text")


@query(f"""
    with d as (select *, {_DOC_KEY} as k from documents)
    select k as key, count(*)::bigint as mentions, min(doc_id) as first_doc, array_agg(text order by length(text) desc, doc_id)[1] as text from d group by k""")
def dedupe_mentions(t):
    return t.documents.withColumn("key", text.key_text("text")).groupBy("key").agg(F.count("*").alias("mentions"), F.min("doc_id").alias("first_doc"), aggs.preferred_text("text", "doc_id").alias("text"))


@query("""
    with e as (select l_partkey, l_orderkey, min(l_linenumber) as line, count(*) as n from lineitem group by all),
    o as (select e.*, o_orderdate, o_orderpriority from e join orders on l_orderkey = o_orderkey),
    r as (select l_partkey, count(*)::bigint as orders, sum(n)::bigint as mentions, max(l_orderkey) as latest_order, min(l_orderkey) as first_order,
        array_to_string(list_sort(list_distinct(array_agg(o_orderpriority))), '|') as priorities from o group by 1)
    select (row_number() over (order by latest_order desc, p_name, p_partkey) - 1)::bigint as id, p_partkey, p_name, orders, mentions, latest_order, first_order, priorities
    from r join part on l_partkey = p_partkey""")
def canonical_records(t):
    episodes = t.lineitem.groupBy("l_partkey", "l_orderkey").agg(F.count("*").alias("n"))
    orders = t.orders.select("o_orderkey", "o_orderpriority")
    seen = episodes.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    records = seen.groupBy("l_partkey").agg(
        F.count("*").alias("orders"), F.sum("n").alias("mentions"), F.max("l_orderkey").alias("latest_order"), F.min("l_orderkey").alias("first_order"),
        F.array_join(aggs.sorted_set(F.col("o_orderpriority")), "|").alias("priorities"),
    )
    named = records.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey")
    return aggs.dense_ids(named, [F.col("latest_order").desc(), F.col("p_name"), F.col("p_partkey")])


@query("""
    select o_custkey, l_orderkey, array_agg(l_shipdate order by l_linenumber, l_shipdate, l_linestatus)[1]::date::varchar as first_ship, array_agg(l_linestatus order by l_linenumber, l_shipdate, l_linestatus)[1] as first_status, count(*)::bigint as lines
    from lineitem join orders on l_orderkey = o_orderkey group by all""")
def episode_rollup(t):
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumn("ord", F.struct("l_linenumber", "l_shipdate", "l_linestatus"))
    out = aggs.rollup(rows, "o_custkey", "l_orderkey", ["l_shipdate", "l_linestatus"])
    counts = rows.groupBy("o_custkey", "l_orderkey").agg(F.count("*").alias("lines"))
    return out.join(counts, ["o_custkey", "l_orderkey"]).select("o_custkey", "l_orderkey", F.col("l_shipdate").cast("date").cast("string").alias("first_ship"), F.col("l_linestatus").alias("first_status"), "lines")


_TOP = "select * from (select l_partkey, l_orderkey, l_linenumber, l_extendedprice, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber)::int as rank from lineitem) where rank <= {0}"


@query(_TOP.format(1))
def best_per_key(t):
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return aggs.best_per_key(rows, ["l_partkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")])


@query(_TOP.format(4))
def topk_per_group(t):
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return aggs.best_per_key(rows, ["l_partkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 4)


_VOTES = """
    with v as (select l_orderkey, p_type as label, 1 as w, l_linenumber as o from lineitem join part on l_partkey = p_partkey
        union all select l_orderkey, p_type, 2, l_linenumber from lineitem join part on l_partkey = p_partkey where contains(lower(p_name), 'bolt')),
    s as (select l_orderkey, label, sum(w)::bigint as score, min(o) as o from v group by all),
    r as (select *, row_number() over (partition by l_orderkey order by score desc, o, label) as r, max(score) over (partition by l_orderkey) as top from s)"""


def _votes(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_type").alias("label"), F.col("l_linenumber").alias("ord"), "p_name")
    cast = lines.withColumn("weight", F.lit(1)).unionByName(lines.where(F.contains(F.lower("p_name"), F.lit("bolt"))).withColumn("weight", F.lit(2)))
    return aggs.votes(cast, "l_orderkey", "label", "weight")


@query(_VOTES + "select l_orderkey, label, score from r where r = 1")
def category_votes(t):
    return _votes(t).where("is_top").select("l_orderkey", "label", "score")


@query(_VOTES + "select l_orderkey, label, score from r where r > 1 and score * 2 >= top")
def secondary_categories(t):
    return _votes(t).where("is_secondary").select("l_orderkey", "label", "score")


@query("""
    select 'lang' as facet, lang as value, count(*)::bigint as n from documents group by lang union all select 'source', source, count(*)::bigint from documents group by source""")
def facet_counts(t):
    pair = F.explode(F.array(F.struct(F.lit("lang").alias("facet"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("facet"), F.col("source").alias("value")))).alias("f")
    return t.documents.select(pair).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query("""
    select case when y between 1990 and 2029 then (y - y % 10)::varchar || 's' when y < 1990 then 'pre-1990' else 'unknown' end as era, count(*)::bigint as n from (select year(o_orderdate) as y from orders) group by 1""")
def era_buckets(t):
    return t.orders.groupBy(era(F.year("o_orderdate")).alias("era")).agg(F.count("*").alias("n"))


def era(y):
    return F.when(y.isNull() | (y == 0) | (y > 2029), "unknown").when(y < 1990, "pre-1990").otherwise(F.concat((y - y % 10).cast("string"), F.lit("s")))


@query("""
    select count(*)::bigint as records, count(distinct source)::bigint as sources, sum(n_chars)::bigint as chars, count_if(quality is not null)::bigint as labelled from documents left join labels using (doc_id)""")
def hero_stats(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    return joined.agg(F.count("*").alias("records"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.count_if(F.col("quality").isNotNull()).alias("labelled"))


@query("""
    select 'text' as field, count_if(coalesce(text, '') <> '')::bigint as filled, count(*)::bigint as total, round_even(100.0 * count_if(coalesce(text, '') <> '') / count(*), 1)::double as percent from documents
    union all select 'label', count_if(quality is not null)::bigint, count(*)::bigint, round_even(100.0 * count_if(quality is not null) / count(*), 1)::double from documents left join labels using (doc_id)""")
def coverage_report(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    stats = joined.agg(F.count("*").alias("total"), F.count_if(text.truthy("text")).alias("a"), F.count_if(F.col("quality").isNotNull()).alias("b"))
    rows = stats.select("total", F.explode(F.array(F.struct(F.lit("text").alias("field"), F.col("a").alias("filled")), F.struct(F.lit("label").alias("field"), F.col("b").alias("filled")))).alias("r"))
    return rows.select("r.field", "r.filled", "total", F.bround(F.lit(100.0) * F.col("r.filled") / F.col("total"), 1).alias("percent"))


@query("select (o_orderkey - o_orderkey % 100)::bigint as bucket, count(*)::bigint as n from orders group by 1")
def bucket100(t):
    return t.orders.groupBy((F.floor(F.col("o_orderkey") / 100) * 100).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("select quality, toxic, count(*)::bigint as n from labels group by all")
def status_counts(t):
    return t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("""
    select lang, case when count_if(source = 'src3') > 0 then 'src3' else array_agg(source order by doc_id)[1] end as source from documents group by lang""")
def source_preference(t):
    preferred = F.struct((F.col("source") == "src3").cast("int"), -F.col("doc_id"))
    return t.documents.groupBy("lang").agg(F.max_by("source", preferred).alias("source"))


@query("select user_id, event_type, count(*)::bigint as flags from events group by all")
def flag_summary(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("flags"))


@query("select p_brand, p_type, count(distinct p_name)::bigint as names from part group by all having count(distinct p_name) >= 3")
def identity_collisions(t):
    return t.part.groupBy("p_brand", "p_type").agg(F.countDistinct("p_name").alias("names")).where("names >= 3")


@query("""
    select * from (select word, count(distinct p_partkey)::bigint as n from (select p_partkey, unnest(string_split(p_name, ' ')) as word from part) group by 1) order by n desc, word limit 12""")
def top_topics(t):
    words = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.countDistinct("p_partkey").alias("n")).orderBy(F.col("n").desc(), "word").limit(12)
