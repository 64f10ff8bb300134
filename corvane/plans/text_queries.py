"""Queries over scalar text and URL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text, urls, vocab
from corvane.functions.urls import LIBRARY
from corvane.plans.base import Catalog

catalog = Catalog()
query = catalog.query

CLEAN = r"(case when trim(regexp_replace({0}, '[\s\x{{00A0}}]+', ' ', 'g')) = '' or lower(trim(regexp_replace({0}, '[\s\x{{00A0}}]+', ' ', 'g'))) in ('n/a','na','nil','none','null','undefined') then null else trim(regexp_replace({0}, '[\s\x{{00A0}}]+', ' ', 'g')) end)"
STOP = ", ".join(f"'{w}'" for w in vocab.MATCH_STOP_WORDS)


def clean(x: str) -> str:
    return CLEAN.format(x)


def key(x: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({clean(x)}), '[^a-z0-9]+', ' ', 'g')), '')"


@query(f"select doc_id, {clean('text')} as cleaned from documents")
def clean_text(t):
    return t.documents.select("doc_id", text.clean_text("text").alias("cleaned"))


@query(f"select doc_id, {key('text')} as key from documents")
def key_text(t):
    return t.documents.select("doc_id", text.key_text("text").alias("key"))


@query(f"""
    select doc_id, array_to_string(list_sort(list_distinct(list_transform(
        list_filter(string_split({key('text')}, ' '), lambda x: length(x) >= 4 and x not in ({STOP})),
        lambda x: case when length(x) > 4 and x like '%s' then left(x, length(x) - 1) else x end))), '|') as tokens from documents""")
def content_tokens(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(text.content_tokens("text")), "|").alias("tokens"))


@query(f"""
    select doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split({key('text')}, ' '), lambda x: length(x) >= 4 and x not in ({STOP})))), '|') as tokens from documents""")
def match_tokens(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(text.match_tokens("text")), "|").alias("tokens"))


@query(r"""
    select page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^http://', 'https://'), '/+$', '') as address,
        regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') as host from pages""")
def url_normalize(t):
    return t.pages.select("page_id", urls.bare("url").alias("address"), urls.domain("url").alias("host"))


@query(r"""
    select regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') as host, count(*)::bigint as pages,
        count(distinct regexp_replace(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^http://', 'https://'), '/+$', ''))::bigint as addresses
    from pages group by 1""")
def url_domain(t):
    return t.pages.groupBy(urls.domain("url").alias("host")).agg(F.count("*").alias("pages"), F.countDistinct(urls.bare("url")).alias("addresses"))


_SEED_URLS = f"""(case p_partkey % 8
    when 0 then 'http://www.{LIBRARY}/pubmed/' || (10000 + p_partkey)
    when 1 then 'https://pubmed.{LIBRARY}/' || (10000 + p_partkey) || '/?from=x'
    when 2 then 'https://doi.org/10.1000/Ab' || p_partkey || '.'
    when 3 then 'https://clinicaltrials.gov/study/NCT' || lpad(cast(p_partkey as varchar(8)), 8, '0')
    when 4 then 'https://www.example.org/Paper/' || p_partkey || '/#top'
    when 5 then 'https://pubmed.{LIBRARY}/?term=x'
    when 6 then null
    else 'https://www.{LIBRARY}/pmc/articles/PMC' || p_partkey || '/' end)"""


@query(f"""
    select p_partkey, case p_partkey % 8
        when 0 then 'pmid|' || (10000 + p_partkey) when 1 then 'pmid|' || (10000 + p_partkey)
        when 2 then 'doi|10.1000/ab' || p_partkey when 3 then 'nct|NCT' || lpad(p_partkey::varchar, 8, '0')
        when 4 then 'url|https://example.org/Paper/' || p_partkey when 7 then 'pmcid|PMC' || p_partkey
        else 'title|' || {key('p_name')} end as identity_key from part""")
def identity_keys(t):
    seeded = t.part.withColumn("url", F.expr(_SEED_URLS.replace("varchar(8)", "string")))
    return seeded.select("p_partkey", urls.mention_key("url", "p_name", "p_brand", F.lit(None)).alias("identity_key"))


@query(f"""
    select p_partkey, case p_partkey % 8
        when 0 then 'https://pubmed.{LIBRARY}/' || (10000 + p_partkey) when 1 then 'https://pubmed.{LIBRARY}/' || (10000 + p_partkey)
        when 2 then 'https://doi.org/10.1000/ab' || p_partkey || '.' when 3 then 'https://clinicaltrials.gov/study/NCT' || lpad(p_partkey::varchar, 8, '0')
        when 4 then 'https://example.org/Paper/' || p_partkey when 7 then 'https://www.{LIBRARY}/pmc/articles/PMC' || p_partkey end as address,
        p_partkey % 8 in (5, 6) as generic, p_partkey % 8 in (0, 1, 2, 3, 7) as likely from part""")
def evidence_urls(t):
    seeded = t.part.withColumn("url", F.expr(_SEED_URLS.replace("varchar(8)", "string")))
    return seeded.select("p_partkey", urls.canonical_form("url").alias("address"), urls.is_generic("url").alias("generic"), urls.likely_evidence("url").alias("likely"))


@query("""
    select p_partkey, case p_partkey % 8
        when 0 then 'pmid|' || (10000 + p_partkey) when 1 then 'pmid|' || (10000 + p_partkey) when 2 then 'doi|10.1000/ab' || p_partkey
        when 3 then 'nct|NCT' || lpad(p_partkey::varchar, 8, '0') when 4 then 'url|https://example.org/Paper/' || p_partkey when 7 then 'pmcid|PMC' || p_partkey end as link_key
    from part""")
def link_identity_keys(t):
    seeded = t.part.withColumn("url", F.expr(_SEED_URLS.replace("varchar(8)", "string")))
    return seeded.select("p_partkey", urls.link_key("p_name", "url").alias("link_key"))


@query(r"""
    with h as (select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') as host from pages),
    b as (select distinct array_to_string(string_split(host, '.')[-2:], '.') as base from h)
    select page_id, base from h join b on host = base or ends_with(host, '.' || base)""")
def domain_suffix_match(t):
    from corvane.operators.joins import suffix_match

    hosts = t.pages.select("page_id", urls.domain("url").alias("host"))
    bases = hosts.select(F.substring_index("host", ".", -2).alias("base")).distinct()
    return suffix_match(hosts, bases, "host", "base").select("page_id", "base")


@query(f"""
    select p_partkey, case when regexp_matches(k, 'meta analysis|metaanalysis') then 'meta-analysis' when regexp_matches(k, 'cochrane|systematic review') then 'systematic review'
        when regexp_matches(k, 'consensus|guideline|recommendation|statement|uspstf') then 'guideline' when regexp_matches(k, 'randomised|randomized|trial') then 'RCT'
        when regexp_matches(k, 'case control|cohort|observational') then 'observational' else 'other' end as study_type
    from (select p_partkey, {key("label")} as k from (select p_partkey, case p_partkey % 6 when 0 then 'Randomized ' when 1 then 'Cohort of ' when 2 then 'META-Analysis: ' when 3 then 'Guideline statement ' when 4 then 'Cochrane trial ' else '' end || p_name as label from part))""")
def study_type_rules(t):
    label = F.concat(F.expr("case p_partkey % 6 when 0 then 'Randomized ' when 1 then 'Cohort of ' when 2 then 'META-Analysis: ' when 3 then 'Guideline statement ' when 4 then 'Cochrane trial ' else '' end"), "p_name")
    return t.part.select("p_partkey", urls.link_study_type(label, F.lit(None).cast("string")).alias("study_type"))


@query("""
    select p_partkey, case p_partkey % 5 when 0 then 'JAMA' when 1 then 'The Lancet' when 2 then 'BMJ' when 3 then 'Diabetes Care' end as journal from part""")
def journal_rules(t):
    label = F.expr("case p_partkey % 5 when 0 then concat(p_name, ' (JAMA 2019)') when 1 then concat('in the Lancet, ', p_name) when 3 then 'diabetes care study' else p_name end")
    url = F.expr("case p_partkey % 5 when 2 then 'https://www.bmj.com/content/1' end")
    return t.part.select("p_partkey", text.journal(label, url).alias("journal"))


@query("""
    select p_partkey, case p_partkey % 5 when 0 then 'RCT' when 1 then 'observational' when 2 then 'meta-analysis' when 3 then 'guideline' else 'other' end as study_type from part""")
def alias_map(t):
    raw = F.expr("case p_partkey % 5 when 0 then ' RCT' when 1 then 'Case-Control' when 2 then 'Meta-Analysis' when 3 then 'guidelines' else p_type end")
    return t.part.select("p_partkey", text.study_type(raw).alias("study_type"))


@query("""
    select o_orderkey, (1900 + o_orderkey % 250)::int as wanted, case when 1900 + o_orderkey % 250 < 2100 then (1900 + o_orderkey % 250)::int end as parsed,
        case when o_orderkey % 3 = 0 then null else o_orderkey % 3 * 1000 + 234 end::bigint as sample from orders""")
def year_and_sample(t):
    said = F.format_string("Published in %d, n = %s", F.expr("1900 + o_orderkey % 250"), F.expr("case when o_orderkey % 3 = 0 then '0' else concat(o_orderkey % 3, ',234 then n = 12') end"))
    return t.orders.select("o_orderkey", F.expr("cast(1900 + o_orderkey % 250 as int)").alias("wanted"), text.year(said).alias("parsed"), text.largest_sample(said).alias("sample"))


@query("""
    select c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g')) as slug, c_custkey % 1000 as number from customer""")
def slug(t):
    title = F.concat(F.lit("Ep #"), F.expr("c_custkey % 1000"), F.lit(": "), F.col("c_name"))
    return t.customer.select("c_custkey", text.slug(title).alias("slug"), text.number_in_title(title, F.lit("")).cast("long").alias("number"))


@query("""
    select r_regionkey::bigint as row_key, sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') as fingerprint from region
    union all select 100 + n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') from nation""")
def fingerprint(t):
    a = t.region.select(F.col("r_regionkey").cast("long").alias("row_key"), text.fingerprint("r_regionkey", "r_name").alias("fingerprint"))
    b = t.nation.select((F.col("n_nationkey") + 100).cast("long").alias("row_key"), text.fingerprint("n_nationkey", "n_name", "n_regionkey").alias("fingerprint"))
    return a.unionByName(b)


@query("select doc_id, trim(regexp_replace(lower(strip_accents(replace(text, 'ß', '|'))), '[^a-z0-9]+', ' ', 'g')) as folded from documents")
def search_text(t):
    return t.documents.select("doc_id", text.search_text("text").alias("folded"))


@query("select c_custkey, sha256('s:' || c_name) as hashed, nullif(left(trim(c_name), 9), '') as short from customer")
def salted_hash(t):
    return t.customer.select("c_custkey", text.salted_hash("c_name", "s").alias("hashed"), text.truncated("c_name", 9).alias("short"))
