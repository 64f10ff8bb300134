"""Queries over joins, upserts, gates and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text, urls
from corvane.operators import joins, review
from corvane.plans.base import Catalog

catalog = Catalog()
query = catalog.query

_ADDRESS = r"regexp_replace(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^http://', 'https://'), '/+$', '')"
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


@query(f"""
    with p as (select page_id, {_ADDRESS} as address, {_HOST} as host from pages), known as (select * from p where page_id % 3 = 0),
    a as (select address, array_agg(page_id order by page_id)[1] as target from known group by 1), h as (select host, array_agg(page_id order by page_id)[1] as target from known group by 1)
    select page_id, coalesce(a.target, h.target) as target, case when a.target is not null then 0 when h.target is not null then 1 end::int as level
    from p left join a using (address) left join h using (host) where page_id % 3 <> 0""")
def alias_cascade(t):
    p = t.pages.select("page_id", urls.bare("url").alias("address"), urls.domain("url").alias("host"))
    known = p.where("page_id % 3 = 0")
    table = known.select(F.explode(F.array("address", "host")).alias("alias"), F.col("page_id").alias("target"), F.col("page_id").alias("ord"))
    return joins.alias_cascade(p.where("page_id % 3 <> 0"), "page_id", [F.col("address"), F.col("host")], table, "alias", "target")


@query("""
    select c_custkey, c_name, o.n as orders from (select * from customer where c_custkey % 2 = 0) left join (select o_custkey as c_custkey, count(*)::bigint as n from orders group by 1) o using (c_custkey)
    union all select o_custkey, null, count(*)::bigint from orders where o_custkey not in (select c_custkey from customer where c_custkey % 2 = 0) group by 1""")
def merge_matched_unmatched(t):
    base = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    extra = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return joins.attach_or_append(base, extra, "c_custkey", ["orders"]).select("c_custkey", "c_name", "orders")


@query("""
    select c_custkey, coalesce(n, 0)::bigint as orders, ids from customer left join (select o_custkey, count(*) n, array_to_string((array_agg(o_orderkey order by o_orderkey))[1:3], '|') ids from orders group by 1) on c_custkey = o_custkey""")
def backlinks(t):
    linked = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 3), "|").alias("ids"))
    return t.customer.join(linked, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), "ids")


@query("""
    with k as (select o_orderkey, case when o_orderkey % 4 = 0 then o_custkey + 10000000 else o_custkey end as custkey, o_custkey % 10000000 as plain from orders)
    select o_orderkey, coalesce(a.c_custkey, b.c_custkey) as custkey, a.c_custkey is null and b.c_custkey is not null as repaired from k left join customer a on custkey = a.c_custkey left join customer b on plain = b.c_custkey""")
def repair_keys(t):
    drift = t.orders.select("o_orderkey", F.expr("case when o_orderkey % 4 = 0 then o_custkey + 10000000 else o_custkey end").alias("custkey"))
    table = t.customer.select(F.col("c_custkey").alias("alias"), F.col("c_custkey").alias("target"), F.col("c_custkey").alias("ord"))
    found = joins.alias_cascade(drift, "o_orderkey", [F.col("custkey"), F.col("custkey") % 10000000], table, "alias", "target")
    return found.select("o_orderkey", F.col("target").alias("custkey"), F.coalesce(F.col("level") > 0, F.lit(False)).alias("repaired"))


@query("""
    select doc_id, source, quality, toxic from documents left join labels using (doc_id)""")
def screening_attach(t):
    return t.documents.select("doc_id", "source").join(joins.last_wins(t.labels, ["doc_id"], "doc_id"), "doc_id", "left")


@query("""
    select doc_id, case when quality = 1 and toxic = 0 then 'approved' when toxic = 1 then 'rejected' else 'pending' end as state, quality = 1 and toxic = 0 as publishable from labels""")
def review_gate(t):
    states = t.labels.select("doc_id", F.expr("case when quality = 1 and toxic = 0 then 'approved' when toxic = 1 then 'rejected' end").alias("status"), F.expr("if(toxic = 0, 'r', null)").alias("reviewed_by"))
    return states.select("doc_id", F.coalesce("status", F.lit("pending")).alias("state"), review.approved("status", "reviewed_by").alias("publishable"))


@query("""
    select l_orderkey, l_linenumber, l_returnflag as support, case l_linestatus when 'O' then 'low' end as confidence from lineitem where l_returnflag <> 'R' and l_returnflag = 'A' and l_linestatus is distinct from 'O'""")
def publishable(t):
    links = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("support"), F.expr("case l_linestatus when 'O' then 'low' end").alias("confidence"), F.expr("if(l_returnflag = 'R', 'rejected', 'approved')").alias("link_status"), F.lit("approved").alias("record_status"), F.lit("r").alias("reviewed_by"))
    return links.where(review.publishable(direct="A")).select("l_orderkey", "l_linenumber", "support", "confidence")


@query("select doc_id, source from documents anti join labels using (doc_id)")
def coverage_gap(t):
    return joins.gap(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("select doc_id, lang from documents semi join (select * from labels where quality = 1) using (doc_id)")
def gap_restrict(t):
    return joins.restrict(t.documents.select("doc_id", "lang"), t.labels.where("quality = 1"), "doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1 or toxic = 1) order by doc_id desc limit 50")
def pending(t):
    return joins.gap(t.documents.select("doc_id"), t.labels.where("quality = 1 or toxic = 1"), "doc_id").orderBy(F.col("doc_id").desc()).limit(50)


@query("""
    select o_custkey, o_orderkey, o_orderstatus from orders where o_orderkey % 2 = 1 union all
    select o_custkey, o_orderkey, o_orderstatus from orders where o_orderkey % 2 = 0 and o_custkey not in (select o_custkey from orders where o_orderkey % 2 = 1)""")
def upsert_replace(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    return joins.replace_groups(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey")


@query("""
    select o_orderkey, 'old' as origin from orders where o_orderkey % 3 <> 0 union all select o_orderkey, 'new' from orders where o_orderkey % 3 = 0""")
def append_new(t):
    o = t.orders.select("o_orderkey")
    return joins.append_new(o.where("o_orderkey % 3 <> 0").withColumn("origin", F.lit("old")), o.withColumn("origin", F.lit("new")), "o_orderkey")


@query("""
    select doc_id, case when toxic = 1 then 'rejected' when quality = 1 and doc_id % 2 = 0 then 'approved' else 'pending' end as status,
        case when toxic = 1 or quality = 1 and doc_id % 2 = 0 then 'reviewer' end as reviewed_by from labels""")
def adjudicate(t):
    rows = t.labels.withColumn("status", F.lit("pending")).withColumn("reviewed_by", F.lit(None).cast("string"))
    rows = review.adjudicate(rows, F.expr("quality = 1 and doc_id % 2 = 0"), "approve", "reviewer")
    return review.adjudicate(rows, F.expr("toxic = 1"), "reject", "reviewer").select("doc_id", "status", "reviewed_by")


@query("""
    with f as (select user_id, count(*)::bigint as flags from events where event_type = 'click' group by 1) select user_id, coalesce(flags, 0)::bigint as flags from (select distinct user_id from events) left join f using (user_id)""")
def feedback_attach(t):
    flags = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("flags"))
    return t.events.select("user_id").distinct().join(flags, "user_id", "left").select("user_id", F.coalesce("flags", F.lit(0)).alias("flags"))


@query(r"""
    with d as (select doc_id, lower(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))) as n from documents), q as (select item_id, lower(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))) as n from benchmark where length(trim(text)) >= 15)
    select doc_id, item_id from d join q on contains(d.n, q.n)""")
def quote_verify(t):
    docs = t.documents.select("doc_id", text.quote_text("text").alias("n"))
    items = t.benchmark.where("length(trim(text)) >= 15").select("item_id", text.quote_text("text").alias("q"))
    return review.containment(docs, "doc_id", "n", items, "q").select("doc_id", "item_id")


@query("""
    select l_orderkey, l_linenumber, l_partkey, case when l_discount > 0.05 then 'high' end as confidence from lineitem join part on l_partkey = p_partkey where l_linenumber <= 3 and l_returnflag in ('A', 'R')
    qualify row_number() over (partition by l_orderkey, l_partkey order by l_linenumber) = 1""")
def link_verification(t):
    links = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.expr("case when l_discount > 0.05 then 'high' else 'unsure' end").alias("confidence"))
    pool = t.part.select("p_partkey")
    ok = review.verify_links(links.where("l_linenumber <= 3"), pool, F.col("l_partkey") == F.col("p_partkey"), "l_returnflag", ["A", "R"], "confidence", ["high"])
    return joins.first_wins(ok, ["l_orderkey", "l_partkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "confidence")


@query("select * from events where event_id > 100 order by event_id limit 500".replace("*", "event_id, user_id, event_type"))
def cursor_read(t):
    return t.events.where("event_id > 100").orderBy("event_id").limit(500).select("event_id", "user_id", "event_type")


@query("""
    select l_orderkey, count(*)::bigint as expected, count_if(l_linenumber <= 5)::bigint as received, count(*) = count_if(l_linenumber <= 5) as complete from lineitem group by 1""")
def batch_completeness(t):
    expected = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("expected"))
    received = t.lineitem.where("l_linenumber <= 5").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return expected.join(received, F.col("l_orderkey") == F.col("k"), "left").select("l_orderkey", "expected", F.coalesce("n", F.lit(0)).alias("received"), (F.col("expected") == F.coalesce("n", F.lit(0))).alias("complete"))
