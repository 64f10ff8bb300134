"""Markup and payload readers: HTML pages, reader markdown, captions, XML records, model JSON."""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import squeeze
from corvane.operators.parsers import chunks, markdown_links, table_function

__all__ = ["chunks", "markdown_links"]

_ANCHOR = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


def html_title(page: Column | str) -> Column:
    return F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)


def anchor_count(page: Column | str) -> Column:
    return F.size(F.regexp_extract_all(page, F.lit(r"(?i)<a\s[^>]*href="), 0))


def anchors(df: DataFrame, page: str) -> DataFrame:
    """(other columns, label, url) of plain anchors, without leaving the JVM."""
    pairs = F.arrays_zip(F.regexp_extract_all(page, F.lit(_ANCHOR), 1).alias("url"), F.regexp_extract_all(page, F.lit(_ANCHOR), 2).alias("label"))
    rest = [c for c in df.columns if c != page]
    out = df.select(*rest, F.explode(pairs).alias("a")).select(*rest, squeeze("a.label").alias("label"), F.col("a.url").alias("url"))
    return out.where("label <> '' and url <> ''")


def published(page: Column | str) -> Column:
    """Date of a page: its published-time meta tag, else its first time tag."""
    meta = F.regexp_extract(page, r"""(?is)<meta[^>]*published_time[^>]*content=["'][^"']*?(\d{4}(?:-\d\d){2})""", 1)
    stamp = F.regexp_extract(page, r"(?is)<time[^>]*>?[^<]*?(\d{4}(?:-\d\d){2})", 1)
    return F.coalesce(F.nullif(meta, F.lit("")), F.nullif(stamp, F.lit("")))


_BLOCKS = frozenset("address article aside blockquote br div dd dl dt footer h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table td th tr ul".split())
_SKIP = frozenset("head noscript script style template".split())


class _Notes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0
        self.href: str | None = None
        self.label: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif tag in _BLOCKS:
            self.parts.append("\n")
        elif tag == "a" and not self.skip:
            self.href, self.label = dict(attrs).get("href"), []

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCKS:
            self.parts.append("\n")
        elif tag == "a" and self.href is not None:
            label = " ".join("".join(self.label).split())
            self.parts.append(f"[{label}]({self.href}) " if label and self.href else label)
            self.href = None

    def handle_data(self, data):
        if not self.skip:
            (self.label if self.href is not None else self.parts).append(data)


def notes_of(page: str) -> str:
    """Visible text of a page, one block a line, anchors as markdown links."""
    parser = _Notes()
    parser.feed(page)
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def page_notes(df: DataFrame, page: str, key: str) -> DataFrame:
    return table_function(df, page, key, lambda t: [(notes_of(t),)], "notes string")


def reader_page(page: str) -> tuple[str, ...]:
    """Title, date and notes of reader markdown: headers up to a marker, then the body."""
    title = re.search(r"(?m)^Title:\s*(.*)$", page)
    date = re.search(r"(?m)^Published Time:.*?(\d{4}(?:-\d\d){2})", page)
    body = page.split("Markdown Content:", 1)[-1]
    for pattern, new in ((r"(?m)^#+\s*", ""), (r"\*\*", ""), (r"(?m)^\s*!\[[^\]]*\]\([^)]*\)\s*$", ""), (r"\n\n\n+", "\n\n")):
        body = re.sub(pattern, new, body)
    return (title[1].strip() if title else "", date[1] if date else "", body.strip())


def caption_lines(vtt: str) -> list[str]:
    """Spoken lines of WebVTT captions: no headers, cues and tags; rolling repeats once."""
    out: list[str] = []
    for line in map(str.strip, vtt.splitlines()):
        if not line or line.isdigit() or "-->" in line or re.match("WEBVTT|NOTE|STYLE|Kind:|Language:", line):
            continue
        line = " ".join(html.unescape(re.sub(r"<[^>]*>", "", line)).split())
        line = re.sub(r"^(?:>>\s*)+", "", line).strip()
        if line and not (out and out[-1].endswith(line)):
            out.append(line)
    return out


def _year(*texts: str | None) -> int | None:
    for t in texts:
        if m := re.search(r"\b(?:20|19)[0-9]{2}\b", t or ""):
            return int(m[0])
    return None


def abstract_record(xml: str) -> dict | None:
    """Title, labelled abstract, journal, year and types of a citation record; None without an abstract or if malformed."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    parts = []
    for node in root.iter("AbstractText"):
        body = " ".join("".join(node.itertext()).split())
        if body:
            parts.append(f"{node.get('Label')}: {body}" if node.get("Label") else body)
    if not parts:
        return None
    text = lambda path: next((" ".join("".join(n.itertext()).split()) for n in root.iterfind(f".//{path}")), None)
    return {
        "title": text("ArticleTitle"), "abstract": "\n".join(parts), "journal": text("Journal/Title") or text("Journal/ISOAbbreviation"),
        "year": _year(text("PubDate/Year"), text("PubDate/MedlineDate")), "types": [" ".join("".join(n.itertext()).split()) for n in root.iter("PublicationType")],
    }


def full_text(xml: str, most: int = 45_000) -> str | None:
    """Paragraphs of an article's body, without tables, figures, references, formulas and supplements."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    skip = {"table-wrap", "fig", "ref-list", "disp-formula", "supplementary-material"}
    found: list[str] = []

    def walk(node: ET.Element) -> None:
        for child in node:
            if child.tag == "p":
                found.append(" ".join("".join(child.itertext()).split()))
            elif child.tag not in skip:
                walk(child)

    for body in root.iter("body"):
        walk(body)
    out = "\n\n".join(x for x in found if x)[:most]
    return out or None


def linked_article(payload: Column | str) -> Column:
    """First link of the pubmed_pmc link set to the pmc database in a link reply (JSON)."""
    kind = "struct<linksets:array<struct<linksetdbs:array<struct<dbto:string,linkname:string,links:array<string>>>>>>"
    sets = F.flatten(F.transform(F.from_json(payload, kind)["linksets"], lambda s: F.coalesce(s["linksetdbs"], F.array())))
    hit = F.filter(sets, lambda s: (s["dbto"] == "pmc") & (s["linkname"] == "pubmed_pmc") & (F.size(s["links"]) > 0))
    return F.try_element_at(F.try_element_at(hit, F.lit(1))["links"], F.lit(1))


def repaired_json(reply: str | None, want: type) -> list | dict:
    """Array or object of a model's reply: thoughts and code fences stripped, else the outermost brackets.

    For an array, an object's first list counts. Anything else gives an empty one.
    """
    text = re.sub(r"(?s)<think>.*?</think>", "", reply or "").strip()
    if fence := re.search(r"(?s)```(?:json)?\s*(.*?)```", text):
        text = fence[1].strip()
    tries = [text]
    for a, b in ("[]", "{}") if want is list else ("{}",):
        if (i := text.find(a)) >= 0 and (j := text.rfind(b)) > i:
            tries.append(text[i : j + 1])
    for t in tries:
        try:
            value = json.loads(t)
        except ValueError:
            continue
        if isinstance(value, want):
            return value
        if want is list and isinstance(value, dict):
            for x in value.values():
                if isinstance(x, list):
                    return x
    return want()


def parsed_reply(reply: str | None, want: type) -> tuple[str | None, str | None]:
    """(JSON, error): a reply that holds no array or object, or is cut off, is an error and not an empty answer."""
    value = repaired_json(reply, want)
    if value:
        return json.dumps(value), None
    bare = re.sub(r"(?s)<think>.*?</think>|```(?:json)?", "", reply or "").strip()
    try:
        if isinstance(json.loads(bare), want | dict):
            return json.dumps(value), None
    except ValueError:
        pass
    return None, "empty reply" if not bare else "no complete JSON in the reply"


def parse_replies(df: DataFrame, key: str, reply: str, want: type = list) -> DataFrame:
    """(key, value, error): the JSON of each model reply, or why there is none; rows with an error are to be asked again."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *parsed_reply(r, want)) for k, r in zip(pdf[key], pdf[reply])]
            yield pd.DataFrame(rows, columns=[key, "value", "error"])

    return df.select(key, reply).mapInPandas(run, f"{key} {kind}, value string, error string")


def reader_pages(df: DataFrame, page: str, key: str) -> DataFrame:
    return table_function(df, page, key, lambda t: [reader_page(t)], "title string, date string, notes string")


def captions(df: DataFrame, vtt: str, key: str) -> DataFrame:
    """(key, line_no, line): spoken lines of WebVTT captions."""
    return table_function(df, vtt, key, lambda t: list(enumerate(caption_lines(t))), "line_no int, line string")


def abstracts(df: DataFrame, xml: str, key: str) -> DataFrame:
    """(key, title, abstract, journal, year, types) of citation records; those without an abstract give no row."""
    names = ("title", "abstract", "journal", "year", "types")
    rows = lambda t: [tuple(r[n] for n in names)] if (r := abstract_record(t)) else []
    return table_function(df, xml, key, rows, "title string, abstract string, journal string, year int, types array<string>")


def full_texts(df: DataFrame, xml: str, key: str) -> DataFrame:
    return table_function(df, xml, key, lambda t: [(x,)] if (x := full_text(t)) else [], "full_text string")


def call_model(df: DataFrame, key: str, prompt: str, model: Callable[[str], str]) -> DataFrame:
    """(key, ok, error, reply): an injected model over prompts; a failure marks its row and no other."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, p in zip(pdf[key], pdf[prompt]):
                try:
                    rows.append((k, True, None, model(p)))
                except Exception as failure:  # noqa: BLE001 - any failure is data here
                    rows.append((k, False, f"{type(failure).__name__}: {failure}", None))
            yield pd.DataFrame(rows, columns=[key, "ok", "error", "reply"])

    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, ok boolean, error string, reply string")
