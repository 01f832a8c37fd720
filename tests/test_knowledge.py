"""Terms, links, entities and quality reports on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftwork.functions import text
from weftwork.operators import entities, links, reports, retrieval, terms
from weftwork.vocab import Vocabulary

EDGE = "array<struct<link_text:string,target_page_id:string,url_raw:string,url_resolved:string,link_type:string,target_anchor:string,source_section_id:string,source_heading_path:array<string>,context:string>>"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("raw", "short"), [("Star Rating", "SR"), ("one", None), ("What All Say", None), ("a b c d e f g h", None), ("Alpha Beta Gamma", "ABG")])
def test_acronyms(spark, raw, short):
    assert one(spark, text.acronym(F.lit(raw))) == short


@pytest.mark.parametrize(("raw", "token"), [("Running", "run"), ("cities", "city"), ("glass", "glass"), ("beats", "beat"), ("maps", "maps"), ("can't", "cant"), ("won't", "wont"), ("STRASSEN", "strassen"), ("'quoted'", "quoted")])
def test_tokens(spark, raw, token):
    assert one(spark, text.normalize_token(F.lit(raw))) == token


def named(spark, *rows):
    return spark.createDataFrame([(r, "s", r) for r in rows], "raw string, source string, hint string")


def test_terms_merge_spellings_and_drop_years(spark):
    made = {r["canonical"]: r["aliases"] for r in terms.merge_terms(terms.add_terms(named(spark, "Combo Burst", "combo burst", "2019", "Hit Object"))).collect()}
    assert set(made) == {"Combo Burst", "Hit Object"}
    assert {"Combo Burst", "combo burst", "Combo Bursts", "CB"} <= set(made["Combo Burst"])


def test_stop_words_are_no_aliases(spark):
    made = terms.merge_terms(terms.add_terms(named(spark, "World Artist Show")))
    assert "WAS" not in made.first()["aliases"]
    asked = spark.createDataFrame([(1, "when was the show")], "query_id int, query string")
    assert retrieval.detect_entities(asked, made).count() == 0


def test_longest_names_win_and_do_not_overlap(spark):
    known = spark.createDataFrame([("beat map", ["beat map"], 1.0), ("beat map pack", ["beat map pack"], 1.0), ("pack", ["packs"], 1.0)], "canonical string, aliases array<string>, score double")
    asked = spark.createDataFrame([(1, "Where is the Beat Map Pack and other packs?"), (2, "beatmap packing")], "query_id int, query string")
    found = sorted((r["query_id"], r["canonical"], r["start"], r["end"]) for r in retrieval.detect_entities(asked, known).collect())
    assert [f[:2] for f in found] == [(1, "beat map pack"), (1, "pack")]
    assert found[0][3] <= found[1][2] or found[1][3] <= found[0][2]


def documents_with(spark, *edges):
    """A document for each (text, target)."""
    rows = [("wiki", f"Page{i}", f"Page{i}", f"Page{i}/en.md", i, [(t, to, to, None, "wiki_article", None, "s", ["s"], f"see {t}")]) for i, (t, to) in enumerate(edges)]
    return spark.createDataFrame(rows, f"source string, document_id string, title string, repo_rel_path string, ordinal int, link_edges {EDGE}")


def decided(spark, *edges, known=None):
    made = links.link_candidates(links.link_rows(documents_with(spark, *edges)), known)
    return {r["alias"]: r for r in made.collect()}


def test_repeated_links_are_accepted(spark):
    r = decided(spark, *[("performance points", "Performance_points")] * 8)["performance points"]
    assert (r["decision"], r["target_count"], r["source_count"], r["ambiguous_target_count"]) == ("accept", 8, 8, 1)


@pytest.mark.parametrize("anchor", ["here", "2019", "the other wiki page", "read more"])
def test_generic_links_are_rejected(spark, anchor):
    assert decided(spark, (anchor, "Some_page"))[anchor]["decision"] == "reject"


def test_ambiguous_links_are_reviewed(spark):
    r = decided(spark, ("star rating", "Stars"), ("star rating", "Rating"))["star rating"]
    assert (r["decision"], r["ambiguous_target_count"], r["target_page_id"]) == ("review", 2, "Stars")
    assert [t["target_page_id"] for t in r["other_targets"]] == ["Rating"]


def test_news_and_unknown_pages_are_no_targets(spark):
    known = spark.createDataFrame([("Known",)], "target_page_id string")
    assert set(decided(spark, ("a post", "news/2020/post"), ("known thing", "Known"), ("other thing", "Unknown"), known=known)) == {"known thing"}


CHUNK = "chunk_id string, document_id string, source_type string, title string, heading_path array<string>, file_path string, text string, ordinal int"


def test_entities_are_found_filtered_and_told_with_context(spark):
    chunks = spark.createDataFrame([("c1", "D1", "wiki", "T", ["T"], "D1/en.md", "Now Ada met the page and Ada Lovelace.", 0), ("c2", "D1", "wiki", "T", ["T"], "D1/en.md", "ada again", 1)], CHUNK)
    out = entities.extract_entities(chunks, "dictionary", {"names": {"Ada": "person", "Ada Lovelace": "person", "page": "page"}}, ["person", "page"]).collect()
    assert sorted((r["text"], r["label"], r["chunk_id"]) for r in out) == [("Ada", "person", "c1"), ("Ada Lovelace", "person", "c1")]
    assert all("Now Ada met" in r["context"] for r in out)
    with pytest.raises(ValueError, match="unknown extraction backend"):
        entities.create_extractor("none")
    with pytest.raises(ValueError, match="unknown label profile"):
        entities.labels_for_profile("none")


def test_round_robin(spark):
    rows = spark.createDataFrame([("A", 0, "a1"), ("A", 1, "a2"), ("A", 2, "a3"), ("B", 3, "b1"), ("C", 4, "c1")], "document_id string, ordinal int, chunk_id string")
    assert {r["chunk_id"] for r in entities.select_chunks(rows, 3).collect()} == {"a1", "b1", "c1"}
    assert {r["chunk_id"] for r in entities.select_chunks(rows, 3, "sequential").collect()} == {"a1", "a2", "a3"}
    with pytest.raises(ValueError):
        entities.select_chunks(rows, 0)


def test_normalisation(spark):
    pages = spark.createDataFrame([("Gameplay/Slider", "Slider", 0), ("Ranking", "Ranking", 1), ("People/Ada", "Ada", 2)], "page_id string, title string, ordinal int")
    kind = "text string, label string, score double, document_id string, chunk_id string, context string, ord int"
    rows = [("sliders", "feature", 0.9, "Gameplay/Slider", "c1", "", 0), ("pp", "feature", 0.9, "X", "c2", "", 1), ("rankings", "page", 0.5, "X", "c3", "", 2), ("Nobody Known", "person", 0.8, "X", "c4", "", 3), ("thing", "x", 0.9, "X", "c5", "", 4)]
    vocab = Vocabulary(manual_targets={"pp": "Ranking"}, generic_terms=("thing",))
    out = {r["example_text"]: r for r in entities.normalize_candidates(spark.createDataFrame(rows, kind), entities.document_index(pages), vocab).collect()}
    assert (out["sliders"]["target_page_id"], out["sliders"]["decision"], out["sliders"]["link_reason"]) == ("Gameplay/Slider", "accept", "source_title")
    assert out["pp"]["target_page_id"] == "Ranking" and out["pp"]["decision_reason"] == "linked_manual_alias"
    assert out["rankings"]["decision"] == "review" and out["Nobody Known"]["decision_reason"] == "high_confidence_unlinked"
    assert out["thing"]["decision"] == "reject"


def test_only_rows_after_the_winner_are_merged_unless_asked(spark):
    pages = spark.createDataFrame([("P", "Pencil", 0)], "page_id string, title string, ordinal int")
    kind = "text string, label string, score double, document_id string, chunk_id string, context string, ord int"
    rows = spark.createDataFrame([("pencil", "x", 0.8, "D1", "c1", "", 0), ("Pencils", "x", 0.9, "D2", "c2", "", 1), ("pencil", "x", 0.7, "D3", "c3", "", 2)], kind)
    index = entities.document_index(pages)
    (late,) = entities.normalize_candidates(rows, index).collect()
    (every,) = entities.normalize_candidates(rows, index, full_merge=True).collect()
    assert (late["mentions"], late["source_document_ids"], every["mentions"]) == (2, ["D2", "D3"], 3)


def test_validation(spark):
    section = "array<struct<section_id:string,text:string>>"
    kind = f"document_id string, ordinal int, source string, title string, repo_rel_path string, url string, sections {section}, date_iso string, preview_paragraph string, style_issues array<string>"
    rows = [
        ("A", 0, "wiki", "A", "A/en.md", "u", [("s", "text")], None, None, []), ("A", 1, "wiki", "A", "A/en.md", "u", [("s", " ")], None, None, []),
        ("N", 2, "news", None, "news/n.md", "u", [], "yesterday", " ", ["missing_series", "missing_banner_image"]),
    ]
    kinds = {(r["kind"], r["identifier"]) for r in reports.validate_documents(spark.createDataFrame(rows, kind)).collect()}
    assert kinds == {("duplicate_document_id", "A"), ("only_empty_sections", "A"), ("missing_document_field", "N"), ("missing_sections", "N"), ("invalid_news_date", "N"), ("missing_news_preview", "N"), ("news_style_issues", "N")}
    named_rows = spark.createDataFrame([("Was", ["was", "Was it"]), ("was", ["w"])], "canonical string, aliases array<string>")
    assert {r["kind"] for r in reports.validate_entities(named_rows).collect()} == {"stopword_alias", "duplicate_entity"}
