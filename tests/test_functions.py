"""Literal cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import text, urls
from corvane.functions.urls import LIBRARY


@pytest.fixture(scope="module")
def value(spark):
    def run(column):
        return spark.range(1).select(column.alias("v")).first().v

    return run


KEY = "https://clinicalkey.com/" + "#!/content/"


def s(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize("raw,want", [("  a \t b\n", "a b"), ("N/A", None), (" none ", None), ("", None), (None, None), ("nil x", "nil x"), ("a b", "a b")])
def test_clean_text(value, raw, want):
    assert value(text.clean_text(s(raw))) == want


@pytest.mark.parametrize("raw,want", [("Über-All: 5%", "ber all 5"), (None, ""), ("null", ""), ("A--b", "a b")])
def test_key_text(value, raw, want):
    assert value(text.key_text(s(raw))) == want


def test_small_functions(value):
    assert value(text.study_type(s("Case-Control"))) == "observational"
    assert value(text.study_type(s("odd"))) == "other"
    assert value(text.tag_list(s("Cardiology; junk / oncology,cardiology"))) == ["cardiology", "oncology"]
    assert value(text.year(s("x 1899, 2020a 2021"))) == 2021
    assert value(text.year(s(None))) is None
    assert value(text.registry_id(s("see nct01234567"))) == "NCT01234567"
    assert value(text.sample_size(s("about 1,234 people"))) == 1234
    assert value(text.sample_size(s("0"))) is None
    assert value(text.largest_sample(s("n = 20 and N=1,400; n=7"))) == 1400
    assert value(text.journal(s("In the Lancet, 2019"), s(None))) == "The Lancet"
    assert value(text.journal(s("nothing"), s("https://www.nejm.org/x"))) == "New England Journal of Medicine"
    assert value(text.content_tokens(s("The trials of Statins and gas"))) == ["statin"]
    assert value(text.match_tokens(s("Statins for patients"))) == ["statins"]
    assert value(text.statement_key(s("Treat it early. (Doe et al. 2020)"))) == "treat it early"
    assert value(text.statement_key(s("Keep (this one) too"))) == "keep this one too"
    assert value(text.ends_sentence(s("Yes! "))) and not value(text.ends_sentence(s("no,")))
    assert value(text.topic_label(s(" - Heart failure,"))) == "Heart failure" and value(text.topic_label(s("Clinical"))) is None
    assert value(text.quotes_verbatim(s("It  says:\nTreat EARLY and often."), s("treat early and  often")))
    assert not value(text.quotes_verbatim(s("too short"), s("too short")))
    assert value(text.number_in_title(s("Heart #123: x"), s(""))) == 123
    assert value(text.numbers_in_title(s("#1 and #22 and #1"))) == [1, 22]
    assert value(text.slug(s("Show #12: Crème & it's Late"))) == "creme-and-its-late"
    assert value(text.search_text(s("Ménière’s  Disease"))) == "meniere s disease"
    assert all(value(text.vague_label(s(x))) for x in (" a recent cohort study.", "12, 4", "The 2020 trials"))
    assert not any(value(text.vague_label(s(x))) for x in ("the alpha study", "", None))
    assert value(text.truncated(s("  abcdef "), 3)) == "abc" and value(text.truncated(s("  "), 3)) is None
    assert value(text.progress(F.lit(5), F.lit(10), 10)) == "[#####-----] 5/10 (50%)"
    assert value(text.decision(s(" Approve "))) == "approved" and value(text.decision(s("x"))) is None
    assert value(text.tidy_transcript(s("a  \r\nb\n\n\n\nc\n"))) == "a\nb\n\nc"
    assert value(text.looks_generated(s("Note: AI-generated transcript"))) and not value(text.looks_generated(s("x" * 800 + "ai-generated")))


@pytest.mark.parametrize(
    "url,norm,identity",
    [
        (f"http://www.{LIBRARY}/pubmed/12345678?x=1", f"https://{LIBRARY}/pubmed/12345678", "pmid|12345678"),
        (f"https://pubmed.{LIBRARY}/12345678/", f"https://pubmed.{LIBRARY}/12345678", "pmid|12345678"),
        (f"https://pubmed.{LIBRARY}/?term=x", None, None),
        (f"https://www.{LIBRARY}/pmc/articles/PMC99/", f"https://{LIBRARY}/pmc/articles/PMC99", "pmcid|PMC99"),
        ("https://clinicaltrials.gov/study/nct01234567", "https://clinicaltrials.gov/study/nct01234567", "nct|NCT01234567"),
        ("https://doi.org/10.1000/AB%2Fc.", "https://doi.org/10.1000/AB/c.", "doi|10.1000/ab/c"),
        ("https://www.example.org/a%20b/#x", "https://example.org/a b", "url|https://example.org/a b"),
        ("https://example.org/", "https://example.org", None),
        ("http://clinicalkey.com#!/content/" + "b9", f"{KEY}b9", f"url|{KEY}b9"),
        ("https://www.clinicalkey.com/", None, None),
        ("not a url", "not a url", None),
        (None, None, None),
        ("https://example.org/a+b", "https://example.org/a+b", "url|https://example.org/a+b"),
    ],
)
def test_urls(value, url, norm, identity):
    assert value(urls.normalize(s(url))) == norm
    assert value(urls.identity(s(url))) == identity


def test_keys(value):
    assert value(urls.mention_key(s(None), s("A  Title!"), s("x"), F.lit(2000))) == "title|a title"
    assert value(urls.mention_key(s(None), s(None), s("Doe"), F.lit(None).cast("int"))) == "label|doe|None"
    assert value(urls.mention_key(s(None), s(None), s(None), F.lit(1))) is None
    assert value(urls.link_key(s("PMC12 in label"), s("https://example.org/x"))) == "pmcid|PMC12"
    assert value(urls.link_key(s("x"), s("https://publisher.org/p?doi=10.1/Ab"))) == "doi|10.1/ab"
    assert value(urls.link_key(s("x"), s("https://www.Example.org/p/?q=1"))) == "url|https://example.org/p"
    assert value(urls.link_key(s("x"), s("https://doi.org/"))) is None
    assert value(urls.doi(s("see 10.1234/xyz(1)."))) == "10.1234/xyz(1"
    assert value(urls.canonical_form(s(f"https://x.{LIBRARY}/pubmed/55555"))) == f"https://pubmed.{LIBRARY}/55555"


def test_domains(value):
    assert value(urls.likely_evidence(s("https://jamanetwork.com/x"))) and value(urls.likely_evidence(s("https://a.b.org/10.1000/x")))
    assert not value(urls.likely_evidence(s("https://www.amazon.com/10.1000/x"))) and not value(urls.likely_evidence(s("https://blog.org/x")))
    assert not value(urls.likely_evidence(s("https://notnejm.org/x"))) and value(urls.likely_evidence(s("https://evidence.nejm.org/x")))
    assert value(urls.link_study_type(s("A systematic review of trials"), s(None))) == "systematic review"
    assert value(urls.is_dead(s("https://null"))) and value(urls.is_dead(s("https://localhost/x"))) and not value(urls.is_dead(s("https://a.b/x")))
    assert value(urls.transcript_link(s("[Transcript](https://show.org/t.pdf) [x](https://else.org/transcript.pdf)"), "show.org")) == "https://show.org/t.pdf"


def test_folding_covers_all_letters_that_decompose(spark):
    import re
    import unicodedata

    assert all(re.fullmatch(text._MAY, c) for c in text._SEVERAL)
    said = ["ő ﬁ Š Ⅳ ﬃ", "Crème Brûlée", "é Ǆ № ＡＢ", "Straße", None, ""]
    plain = lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
    want = [re.sub("[^a-z0-9]+", " ", plain(v or "").lower()).strip() for v in said]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(said)], "i int, v string").orderBy("i")
    assert [r.s for r in df.select("i", text.search_text("v").alias("s")).orderBy("i").collect()] == want
    assert [r.s for r in df.select("i", text.slug("v").alias("s")).orderBy("i").collect()][1:2] == ["creme-brulee"]
