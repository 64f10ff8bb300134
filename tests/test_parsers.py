"""Table functions and payload readers."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import parsers, windows
from corvane.sources import markup


def test_links():
    assert parsers.links("a [L 1](http://x.y/(a)b) [ftp](ftp://x) [un](http://open( [ok](https://z)") == [("L 1", "http://x.y/(a)b"), ("ok", "https://z")]
    assert parsers.links("[stray [A](http://a)") == [("stray [A", "http://a")]
    assert parsers.links("") == [] and parsers.links("[x](") == []


def test_chunks_overlap_and_cut():
    text = "\n".join(f"line {i:02d} " + "x" * 20 for i in range(10))
    got = parsers.chunk(text, 100, 1)
    assert len(got) > 3 and all(b[1].split("\n")[0] == a[1].split("\n")[-1] for a, b in zip(got, got[1:]))
    assert [len(c) for _, c in parsers.chunk("y" * 250, 100)] == [100, 100, 50]
    assert parsers.chunk(" \n n/a \n") == []


NOTES = """Intro line
Heart Failure Pearls:
1.
- Start quadruple therapy early in every patient.
- Sodium limits help (
[Doe 2020](https://x.y/z)
)
and fluids matter less than once thought.
* short one
Clinical Pearls
Start quadruple therapy early in every patient with reduced function.
Start quadruple therapy early in every patient. (Doe 2019)
Diuretics In Acute Heart Failure
This is body prose.
Matt's Pearl –
Use the lowest dose that works for the shortest time.
Heart Notes – Show Notes
Never read this one as a statement at all.
"""


def test_statements():
    got = parsers.statements(NOTES)
    assert got == [
        ("Heart Failure", "Start quadruple therapy early in every patient. (Doe 2019)"),
        ("Heart Failure", "Sodium limits help ([Doe 2020](https://x.y/z)) and fluids matter less than once thought."),
        (None, "Start quadruple therapy early in every patient with reduced function."),
        (None, "Use the lowest dose that works for the shortest time."),
    ]
    assert parsers.statements("") == []


def test_statement_rules():
    assert parsers.is_statement("Five words are enough here.") and not parsers.is_statement("Too few words.")
    assert not parsers.is_statement("Heart failure w/ Dr. Doe and many other people in the room") and not parsers.is_statement("Subscribe to the show now please.")
    assert parsers.topic_of("Rahul Doe's") is None and parsers.topic_of("Women's Hematology -") == "Women's Hematology"
    assert parsers.is_section_heading("Treatment of Acute Pain") and not parsers.is_section_heading("treatment is often delayed in pain")
    assert parsers.join_wrapped(["Give 5", "mg daily", "Next item here is new."], 0) == ("Give 5 mg daily", 2)
    assert parsers.join_wrapped(["Check HbA1", "C", "then stop."], 0) == ("Check HbA1C then stop.", 3)


SEGMENTS = """Show Segments
Intro and pun
Heart failure basics
Kidney stones and diet

Outro

Sponsor stuff
Heart Failure Basics
%s
Basics of heart failure
%s
Kidney Stones
[cite](https://x.y)
short tail
""" % ("p" * 75 + ".", "q" * 75 + ".")


def test_segments_and_sections():
    assert parsers.segments(SEGMENTS) == [(0, "Heart failure basics", "heart failure basics"), (1, "Kidney stones and diet", "kidney stones and diet"), (2, "Sponsor stuff", "sponsor stuff"), (3, "Heart Failure Basics", "heart failure basics")]
    assert parsers.segments("no contents") == []
    notes = SEGMENTS.replace("\nOutro\n", "\n\n")
    assert [x[:3] for x in parsers.segments(notes)] == [(0, "Heart failure basics", "heart failure basics"), (1, "Kidney stones and diet", "kidney stones and diet")]
    got = parsers.sections(notes)
    assert [(i, t) for i, t, _, _ in got] == [(0, "Heart failure basics"), (1, "Kidney stones and diet")]
    assert got[0][3] == got[1][2] and got[1][3] == len(notes.splitlines())


def test_captions():
    vtt = "WEBVTT\nKind: captions\n\n1\n00:00:01.000 --> 00:00:02.000\n<c>Hello</c> &amp; welcome\n\n2\n00:00:02.000 --> 00:00:03.000\n>> welcome\nto the show"
    assert markup.caption_lines(vtt) == ["Hello & welcome", "to the show"]


def test_pages():
    html = "<html><head><title>T &amp; x</title><style>a{}</style></head><body><h1>Head</h1><p>One <a href='/u'>link  me</a> two</p><script>no()</script><p>Three</p></body></html>"
    assert markup.notes_of(html) == "Head\nOne [link me](/u) two\nThree"
    assert markup.reader_page("Title: A\nPublished Time: 2024-02-03T00:00\nMarkdown Content:\n# H\n**b** x\n![i](u)\n\n\n\ny") == ("A", "2024-02-03", "H\nb x\n\ny")


def test_xml_records():
    xml = "<a><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label='AIM'>x <i>y</i></AbstractText><AbstractText>z</AbstractText></Abstract><Journal><ISOAbbreviation>J</ISOAbbreviation></Journal><PubDate><MedlineDate>1999 Jan</MedlineDate></PubDate><PublicationType>Review</PublicationType></a>"
    assert markup.abstract_record(xml) == {"title": "T", "abstract": "AIM: x y\nz", "journal": "J", "year": 1999, "types": ["Review"]}
    assert markup.abstract_record("<a><ArticleTitle>T</ArticleTitle></a>") is None and markup.abstract_record("<a>") is None
    assert markup.full_text("<x><body><sec><p>One</p><fig><p>no</p></fig><p>T<b>wo</b></p></sec></body></x>") == "One\n\nTwo"


@pytest.mark.parametrize("reply,want", [("<think>x</think>```json\n[1,2]\n```", [1, 2]), ('text {"items": [3]} more', [3]), ("garbage", []), (None, []), ("see [1, 2] end", [1, 2])])
def test_array_repair(reply, want):
    assert markup.repaired_json(reply, list) == want


def test_object_repair():
    assert markup.repaired_json('so {"a": 1} ok', dict) == {"a": 1} and markup.repaired_json("[1]", dict) == {}


def test_link_reply(spark):
    reply = json.dumps({"linksets": [{"linksetdbs": [dict(dbto="pmc", linkname=n, links=x.split()) for n, x in (("other", "1"), ("pubmed_pmc", "2 3"))]}]})
    rows = spark.createDataFrame([(reply,), ("{}",), ("x",)], "r string").select(markup.linked_article(F.col("r")).alias("v")).collect()
    assert [r.v for r in rows] == ["2", None, None]


def test_table_functions(spark):
    df = spark.createDataFrame([(1, NOTES), (2, None), (3, "")], "k long, t string")
    assert parsers.statement_rows(df, "t", "k").count() == 4
    assert parsers.segment_rows(df, "t", "k").count() == 0 and parsers.section_rows(df, "t", "k").count() == 0


def test_model_failures_stay_in_their_row(spark):
    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return prompt.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "k long, p string")
    got = {r.k: (r.ok, r.error, r.reply) for r in markup.call_model(df, "k", "p", model).collect()}
    assert got == {1: (True, None, "A"), 2: (False, "RuntimeError: no", None), 3: (True, None, "C")}


def test_lines_and_folds(spark):
    df = spark.createDataFrame([(1, "a\r\nb c\n"), (2, None), (3, "")], "k long, t string")
    assert [(r.k, r.line_no, r.line) for r in windows.lines_of(df, "t", "k").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]
    fold = spark.range(1).select(windows.fold_captions(F.array(*map(F.lit, ["a b", "b", "c", "b"]))).alias("v")).first().v
    assert fold == ["a b", "c", "b"]
