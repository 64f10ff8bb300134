"""URL and identifier functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import vocab
from corvane.functions.text import _c, clean_text, key_text, let, nullify

#: host of the library whose ids name publications
LIBRARY = "ncbi.nlm.nih.gov"

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column | str, n: int) -> Column:
    return F.regexp_extract(_c(url), _URL, n)


def domain(url: Column | str) -> Column:
    """Host in lower case without ``www.``; '' where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(_part(url, 2)), "^www\\.", ""), F.lit(""))


def unescape(v: Column | str) -> Column:
    """Percent escapes decoded, a plus stays; text with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(_c(v), "\\+", "%2B")), _c(v))


def _path(url: Column | str) -> Column:
    return F.regexp_replace(unescape(_part(url, 3)), "/+$", "")


def is_generic(url: Column | str) -> Column:
    """Search and home pages, which identify no publication; null counts as one."""
    return let(clean_text(url), lambda u: let(F.struct(domain(u).alias("host"), F.lower(_path(u)).alias("path"), F.lower(unescape(_part(u, 5))).alias("mark")), lambda p: u.isNull() | _generic(p)))


def _generic(p: Column) -> Column:
    host, path = p["host"], p["path"]
    tests = [
        (host == f"pubmed.{LIBRARY}") & ~path.rlike(r"^/\d{4,9}$"),
        host.endswith(LIBRARY) & path.isin("/pmc/articles", "/pmc", "/pubmed", ""),
        host.endswith("clinicalkey.com") & (path == "") & ~p["mark"].startswith("!/content/"),
        host.isin("clinicaltrials.gov", "dx.doi.org", "doi.org") & (path == ""),
    ]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def normalize(url: Column | str) -> Column:
    """https, no www, query or trailing slash; generic pages become null, text that is no URL stays."""

    def parts(u: Column) -> Column:
        host = domain(u)
        return F.struct(host.alias("host"), _path(u).alias("path"), F.when(host.endswith("clinicalkey.com"), _part(u, 5)).otherwise("").alias("mark"), (u.rlike(_URL) & (_part(u, 2) != "")).alias("is_url"))

    def whole(p: Column) -> Column:
        tail = F.when((p["mark"] != "") & (p["path"] == ""), "/").otherwise(p["path"])
        return F.concat(F.lit("https://"), p["host"], tail, F.when(p["mark"] != "", F.concat(F.lit("#"), p["mark"])).otherwise(""))

    def form(u: Column) -> Column:
        return let(parts(u), lambda p: F.when(u.isNull(), None).when(~p["is_url"], u).otherwise(let(whole(p), lambda full: F.when(~is_generic(full), full))))

    return let(F.regexp_replace(clean_text(url), "http://", "https://"), form)


def bare(url: Column | str) -> Column:
    """Page address of a crawl: https, no query, fragment or trailing slash."""
    u = F.regexp_replace(F.regexp_replace(F.trim(_c(url)), "[?#].*$", ""), "^http://", "https://")
    return F.regexp_replace(u, "/+$", "")


_LIBRARY = LIBRARY.replace(".", "[.]")
_PMID_AT_HOST = f"(?i)(?:{_LIBRARY}/pubmed/|pubmed[.]{_LIBRARY}/)([0-9]{{4,9}})"
_PMID_ANY = f"(?i)(?:/pubmed/|pubmed[.]{_LIBRARY}/)([0-9]{{4,9}})"
_PMCID = r"(?i)\bPMC[0-9]+\b"
_NCT = r"(?i)\bNCT[0-9]{8}\b"
_DOI = r"(?i)\b10[.][0-9]{4,9}/[A-Z0-9/:;._()-]+\b"


def _find(v: Column | str, regex: str, group: int = 0) -> Column:
    return nullify(F.regexp_extract(_c(v), regex, group))


def pmid(v: Column | str) -> Column:
    return _find(v, _PMID_ANY, 1)


def pmcid(v: Column | str) -> Column:
    return F.upper(_find(v, _PMCID))


def nct(v: Column | str) -> Column:
    return F.upper(_find(v, _NCT))


def doi(v: Column | str) -> Column:
    """Path at a doi.org host, else the query's doi, else the first DOI in the text."""

    def find(u: Column) -> Column:
        at_host = nullify(F.regexp_replace(_part(u, 3), "^/+", ""))
        asked = _find(u, r"[?&](?:doi|DOI)=([^&#]+)", 1)
        loose = F.regexp_replace(_find(u, _DOI), "[).,;]+$", "")
        return F.lower(F.when(domain(u).isin("doi.org", "dx.doi.org"), at_host).otherwise(F.coalesce(asked, loose)))

    return let(unescape(v), find)


def _first_key(tagged: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.concat(F.lit(f"{kind}|"), value) for kind, value in tagged])


def identity(url: Column | str) -> Column:
    """``kind|value`` of a publication by its URL alone: pmid, pmcid, nct, doi, url; else null."""

    def page(whole: Column) -> Column:
        place = (F.regexp_replace(_part(whole, 3), "/+$", "") != "") | (_part(whole, 5) != "")
        return F.when(place, whole)

    def key(plain: Column) -> Column:
        return _first_key(
            [
                ("pmid", _find(plain, _PMID_AT_HOST, 1)),
                ("pmcid", F.upper(_find(plain, _PMCID))),
                ("nct", F.upper(_find(plain, _NCT))),
                ("doi", F.lower(F.regexp_replace(_find(plain, _DOI), "[).,;]+$", ""))),
            ]
        )

    return let(clean_text(url), lambda u: F.coalesce(let(unescape(u), key), F.concat(F.lit("url|"), let(normalize(u), page))))


def mention_key(url: Column | str, title: Column | str, label: Column | str, yr: Column | str) -> Column:
    """Key of a mention: publication, else title, else label and year (a missing year reads None)."""
    t, lab = nullify(key_text(title)), nullify(key_text(label))
    return F.coalesce(identity(url), F.concat(F.lit("title|"), t), F.concat(F.lit("label|"), lab, F.lit("|"), F.coalesce(_c(yr).cast("string"), F.lit("None"))))


def canonical_form(url: Column | str) -> Column:
    """One address per publication; other pages keep host and path only."""

    def form(u: Column) -> Column:
        known = F.struct(domain(u).alias("host"), _path(u).alias("path"), pmid(u).alias("pmid"), pmcid(u).alias("pmcid"), nct(u).alias("nct"), doi(u).alias("doi"))
        return let(
            known,
            lambda k: F.when(u.isNull() | (_part(u, 2) == ""), u)
            .when(k["pmid"].isNotNull(), F.concat(F.lit(f"https://pubmed.{LIBRARY}/"), k["pmid"]))
            .when(k["pmcid"].isNotNull(), F.concat(F.lit(f"https://www.{LIBRARY}/pmc/articles/"), k["pmcid"]))
            .when(k["host"].endswith("clinicaltrials.gov") & k["nct"].isNotNull(), F.concat(F.lit("https://clinicaltrials.gov/study/"), k["nct"]))
            .when(k["host"].isin("doi.org", "dx.doi.org") & k["doi"].isNotNull(), F.concat(F.lit("https://doi.org/"), k["doi"]))
            .otherwise(F.concat(F.lit("https://"), k["host"], k["path"])),
        )

    return let(normalize(url), form)


def link_key(label: Column | str, url: Column | str) -> Column:
    """Key of a show-note link by label and URL together: pmid, doi, pmcid, nct, url; else null."""
    both = F.concat_ws(" ", nullify(label), nullify(url))
    return F.coalesce(let(both, lambda b: _first_key([("pmid", pmid(b)), ("doi", doi(b)), ("pmcid", pmcid(b)), ("nct", nct(b))])), F.concat(F.lit("url|"), canonical_form(url)))


def in_domains(host: Column | str, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    h = _c(host)
    out = h.isin(domains)
    for d in domains:
        out = out | h.endswith(f".{d}")
    return out


def likely_evidence(url: Column | str, excluded: list[str] | None = None) -> Column:
    """Whether a link leads to a publication: it has an identifier or a known domain, and no excluded one."""

    def test(u: Column) -> Column:
        known = pmid(u).isNotNull() | pmcid(u).isNotNull() | doi(u).isNotNull() | nct(u).isNotNull()
        return let(domain(u), lambda host: u.isNotNull() & ~in_domains(host, excluded or vocab.EXCLUDED) & (known | in_domains(host, vocab.HIGH_CONFIDENCE + vocab.EVIDENCE)))

    return F.coalesce(let(canonical_form(url), test), F.lit(False))


def link_study_type(label: Column | str, url: Column | str) -> Column:
    both = key_text(F.concat_ws(" ", nullify(label), nullify(url)))
    return let(both, lambda text: F.coalesce(*[F.when(text.rlike(terms), kind) for terms, kind in vocab.LINK_STUDY_RULES], F.lit("other")))


def is_dead(url: Column | str) -> Column:
    """A URL that leads nowhere: a written null, the library's bare home page, or a host without a dot. A missing one isn't dead."""
    u = F.trim(_c(url))
    host = _part(u, 2)
    home = f"https://pubmed.{LIBRARY}"
    return F.coalesce(_c(url) != "", F.lit(False)) & (F.lower(u).isin("null", "none", home, f"{home}/") | ((host != "") & ~F.contains(host, F.lit("."))))


def clear_dead(df: DataFrame, url: str) -> DataFrame:
    """The table with dead URLs set to null."""
    return df.withColumn(url, F.when(~is_dead(url), F.col(url)))


def transcript_link(notes: Column | str, own_host: str) -> Column:
    """First markdown link to a document of the own host that speaks of a transcript."""
    found = F.regexp_extract_all(F.coalesce(_c(notes), F.lit("")), F.lit(r"\[[^\]]*\]\([^()\s]+\)"), 0)
    ok = F.filter(found, lambda x: x.rlike(rf"(?i)transcript") & x.rlike(rf"(?i)\]\(https?://(?:[^/)]*\.)?{own_host}/[^)]*\.(?:pdf|docx?)\)$"))
    return nullify(F.regexp_extract(F.try_element_at(ok, F.lit(1)), r"\]\(([^()]*)\)$", 1))
