"""Markdown pages: sections, ids, tables, formulas, citations, links, news fields; and their chunks."""

from __future__ import annotations

import time

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftwork.functions import markdown as md
from weftwork.operators.chunking import build_chunks, split_text_blocks, table_parts
from weftwork.operators.structure import parse_pages
from weftwork.vocab import Vocabulary

SITE = Vocabulary(hosts=("site.example",), base_url="https://site.example")
WIKI = """---
tags:
  - first tag
  - second
---
# Widget

<!-- not shown -->A [gadget](/wiki/Gadget) is near. ::{ kind=tool }::

## Parts of it {id=parts}

| Name | Amount |
| :-- | --: |
| Bolt | 4 |
| Nut | 5 |

The weight is `w = 2 * n` here.[^note] See [notes](/wiki/Notes_(odd)) and https://other.example/page, too.

### Deep

![A picture](/wiki/shared/pic.png "On top")

## Parts of it

Last words of [ref][key].

[^note]: Measured once.
[key]: https://site.example/wiki/Other#Part
"""
NEWS = """---
layout: post
title: "A day out"
date: 2024-05-06 07:08:09 +0200
series: Outings, Walks
---
![](/wiki/shared/banner.jpg)

First *words* of the [day](https://other.example/).

## Then

More.
"""


@pytest.fixture(scope="module")
def docs(spark):
    files = spark.createDataFrame([("Widget/en.md", WIKI), ("news/2024/2024-05-06-day-out.md", NEWS), ("Empty/en.md", "")], "rel_path string, text string")
    return {r["document_id"]: r.asDict(True) for r in parse_pages(files, SITE).collect()}


def test_wiki_page(docs):
    d = docs["Widget"]
    assert (d["source"], d["title"], d["tags"], d["url"]) == ("wiki", "Widget", ["first tag", "second"], "https://site.example/wiki/en/Widget")
    assert [s["section_id"] for s in d["sections"]] == ["widget", "parts", "deep", "parts-of-it"]
    assert [s["level"] for s in d["sections"]] == [1, 2, 3, 2]
    assert d["sections"][2]["heading_path"] == ["Widget", "Parts of it", "Deep"] and d["sections"][2]["parent_section_id"] == "parts"
    assert d["sections"][0]["directives"] == [{"key": "kind", "value": "tool"}]
    parts = d["sections"][1]
    assert parts["table_count"] == 1 and parts["tables"][0]["rows"] == [["Bolt", "4"], ["Nut", "5"]] and parts["tables"][0]["alignments"] == ["left", "right"]
    assert [f["expression"] for f in parts["formulae"]] == ["w = 2 * n"] and "Row 2: Name=Nut; Amount=5" in parts["text"]
    assert "not shown" not in str(d["sections"]) and d["image_count"] == 1 and d["sections"][2]["images"][0]["title"] == "On top"


def test_links_and_citations(docs):
    d = docs["Widget"]
    told = [(e["link_text"], e["link_type"], e["target_page_id"], e["target_anchor"]) for e in d["link_edges"]]
    assert ("gadget", "wiki_article", "Gadget", None) in told and ("notes", "wiki_article", "Notes_(odd)", None) in told
    assert ("ref", "wiki_section", "Other", "part") in told
    assert any(kind == "external" and text == "https://other.example/page" for text, kind, *_ in told)
    assert any("A gadget is near" in e["context"] for e in d["link_edges"])
    (c,) = d["citations"]
    assert (c["citation_id"], c["text"], c["missing_definition"], c["referenced_in_sections"]) == ("note", "Measured once.", False, ["parts"])


def test_news_post(docs):
    d = docs["news/2024/2024-05-06-day-out"]
    assert (d["source"], d["title"], d["date_iso"], d["filename_date"], d["slug"], d["year"]) == ("news", "A day out", "2024-05-06T07:08:09+02:00", "2024-05-06", "day-out", "2024")
    assert d["series_tags"] == ["Outings", "Walks"] and d["preview_paragraph"] == "First words of the day." and d["banner_image"]["url_raw"].endswith("banner.jpg")
    assert d["style_issues"] == []


def test_empty_page(docs):
    assert docs["Empty"]["title"] == "Empty" and docs["Empty"]["edge_count"] == 0


def test_all_kinds_of_chunks(spark):
    files = spark.createDataFrame([("Widget/en.md", WIKI)], "rel_path string, text string")
    chunks = build_chunks(parse_pages(files, SITE)).collect()
    assert {c["chunk_type"] for c in chunks} == {"article", "section", "table", "formula", "citation"}
    assert len({c["chunk_id"] for c in chunks}) == len(chunks) and all(c["url"] and c["heading_path"] for c in chunks)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_long_text_is_split_without_loss(spark):
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(120)) for i in range(8))
    parts = one(spark, split_text_blocks(F.lit(text), 1200))
    assert len(parts) > 1 and all(len(p) <= 1200 for p in parts) and " ".join(parts).split() == text.split()
    hard = one(spark, split_text_blocks(F.lit("y" * 3000 + " z"), 1200))
    assert hard == ["y" * 1200, "y" * 1200, "y" * 600 + "\n\nz"]


def test_long_table_keeps_all_rows(spark):
    rows = F.array(*[F.array(F.lit(f"r{i}"), F.lit(str(i))) for i in range(6)])
    parts = one(spark, table_parts(F.lit("T"), F.lit("S"), F.array(F.lit("a"), F.lit("b")), rows, 2))
    assert len(parts) == 3 and "Row 1: a=r0; b=0" in parts[0] and "Row 6: a=r5; b=5" in parts[2]
    assert all(p.startswith("Article: T\nSection: S\nColumns: a, b") for p in parts)


@pytest.mark.parametrize(
    ("raw", "iso"),
    [("2020-1-2 3:04:05 +0000", "2020-01-02T03:04:05+00:00"), ("2020-01-02 03:04:05", "2020-01-02T03:04:05"), ("2020-01-02", "2020-01-02T00:00:00"), ("2020-13-02", None), ("soon", None), (None, None)],
)
def test_news_dates(spark, raw, iso):
    assert one(spark, md.news_date(F.lit(raw).cast("string"))) == iso


def test_links_with_parentheses_and_fences():
    assert [(t, u) for *_, t, u in md.scan_links("a [b](c_(d)_e) ![i](j) ```[x](y)``` [k](l")] == [("b", "c_(d)_e")]


@pytest.mark.parametrize(("target", "path"), [("../Other", "Other"), ("./Sub/en.md", "Widget/Sub"), ("..", "Widget"), ("../..", None), ("../../x", None), ("Part.md", "Widget/Part")])
def test_relative_paths(spark, target, path):
    assert one(spark, md.resolved_path(F.lit("Widget/en.md"), F.lit(target))) == path


#: A link as a grammar: the target is escaped characters, others than parentheses and line ends, and targets in parentheses.
LINK = regex.compile(r"\[([^\]]*)\]\((?P<t>(?:\\[\s\S]|[^()\\\n]|\((?&t)\))*+)\)")


def brute_links(text: str) -> list[tuple]:
    out, i, fenced = [], 0, False
    while i < len(text):
        link = None if fenced or text[i - 1 : i] == "!" else LINK.match(text, i)
        if text.startswith("```", i):
            fenced, i = not fenced, i + 3
        elif link:
            out.append((i, link.end(), link[1], link["t"]))
            i = link.end()
        else:
            i += 1
    return out


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="[]()!`\\\na", max_size=30).map(lambda t: t.replace("`", "```").replace("]", "](")) | st.text(alphabet="[]()!`\\\na", max_size=30))
def test_links_as_the_grammar_says(text):
    assert md.scan_links(text) == brute_links(text)


@pytest.mark.parametrize("unit", ["[", "[a](b", "[a](", "[a](b)", "](", "[](("])
def test_links_of_long_texts_take_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    md.scan_links(text)
    assert time.perf_counter() - began < 10  # seconds; about one on an idle machine
