"""Ranking on small fixtures: titles, intents and their routes, entities, vectors, evaluation and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import evaluation, prompting, retrieval
from weftwork.operators.chunking import build_chunks

SECTION = "array<struct<section_id:string,title:string,heading_path:array<string>,text:string,tables:array<struct<headers:array<string>,rows:array<array<string>>>>,formulae:array<struct<source:string,expression:string>>>>"
DOC = (
    "source string, page_id string, document_id string, repo_rel_path string, url string, title string, tags array<string>, series_tags array<string>, domain string, subculture string, topic string, slug string, "
    f"year string, series_primary string, preview_paragraph string, date_iso string, filename_date string, sections {SECTION}, citations array<struct<citation_id:string,text:string>>, section_parts array<string>"
)


def page(spark, *pages):
    """Documents of (id, title, area, text)."""
    rows = [
        ("wiki", i, i, f"{i}/en.md", f"https://x/{i}", title, [], [], i.split("/")[0].lower(), area, i.split("/")[0], None, None, None, None, None, None, [("body", "Body", ["Body"], text, [], [])], [], ["Body"])
        for i, title, area, text in pages
    ]
    docs = spark.createDataFrame(rows, DOC)
    return docs, build_chunks(docs)


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id int, query string")


def top(df, query_id=0):
    return [r for r in sorted(df.collect(), key=lambda r: r["rank"]) if r["query_id"] == query_id]


def test_title_match_comes_first(spark):
    docs, chunks = page(spark, ("Ranking", "Ranking", "gameplay", "how players are ranked"), ("Slider", "Slider", "gameplay", "ranking of sliders and more"))
    found = top(retrieval.search(ask(spark, "ranking"), chunks, docs))
    assert found[0]["document_id"] == "Ranking" and [r["rank"] for r in found] == list(range(1, len(found) + 1))


def test_trouble_goes_to_help(spark):
    docs, chunks = page(
        spark, ("Help_centre/Client", "Client", "help", "1. open settings when the client lags"), ("Help_centre", "Help centre", "help", "all help"), ("Gameplay", "Gameplay", "gameplay", "the game is played with a client")
    )
    asked = ask(spark, "my client is broken, how to fix the issue?")
    scores = {r["document_id"]: r["score"] for r in retrieval.document_scores(retrieval.with_intent(asked), docs).collect()}
    assert scores["Help_centre"] > 0
    assert {r["document_id"] for r in top(retrieval.search(asked, chunks, docs))[:2]} <= {"Help_centre", "Help_centre/Client"}


def test_performance_goes_to_its_page(spark):
    docs, chunks = page(spark, ("Performance_troubleshooting", "Performance troubleshooting", "help", "lower settings"), ("Performance_points", "Performance points", "gameplay", "lag lag lag fps"))
    assert top(retrieval.search(ask(spark, "why is my fps so low and everything lagging"), chunks, docs))[0]["document_id"] == "Performance_troubleshooting"


def test_intents(spark):
    r = retrieval.with_intent(ask(spark, "What is a slow crash and how to open it?", "hello")).orderBy("query_id").collect()
    assert r[0]["labels"] == ["access", "definition", "performance", "troubleshooting"] and "fps" in r[0]["expanded"]
    assert r[1]["labels"] == [] and r[1]["expanded"] == ["hello"]


def test_chunks_inherit_from_the_best_page_above(spark):
    _, chunks = page(spark, ("A", "A", "general", "x"), ("A/B", "B", "general", "y"), ("A/B/C", "C", "general", "z"))
    scores = spark.createDataFrame([(0, "A", 10.0), (0, "A/B", 2.0)], "query_id int, document_id string, score double")
    got = {r["chunk_id"]: round(r["document_score"], 6) for r in retrieval.chunk_document_scores(scores, chunks).collect()}
    assert got["A::section::body"] == 10.0 and got["A/B::section::body"] == 2.0 and got["A/B/C::section::body"] == 7.0
    assert got["A::article"] == 11.5


def test_detected_entities_count(spark):
    docs, chunks = page(spark, ("Mods/Hidden", "Hidden", "gameplay", "objects fade"), ("Other", "Other", "general", "nothing"))
    known = spark.createDataFrame([("Hidden", ["HD", "Hidden"], 1.5)], "canonical string, aliases array<string>, score double")
    found = top(retrieval.search(ask(spark, "what does HD do"), chunks, docs, known))
    assert found[0]["document_id"] == "Mods/Hidden" and found[0]["entity_score"] >= 8


def test_dense_scores(spark):
    vectors = spark.createDataFrame([(f"c{i}", [float(i == 0), float(i > 0)]) for i in range(4)], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(0, [0.0, 1.0])], "query_id int, query_embedding array<float>")
    assert sorted((r["chunk_id"], r["dense_score"]) for r in retrieval.dense_scores(asked, vectors, 2).collect()) == [("c1", 1.0), ("c2", 1.0)]


def test_questions_without_candidates_get_the_first_chunks(spark):
    docs, chunks = page(spark, ("A", "A", "general", "x"), ("B", "B", "general", "y"))
    assert len(top(retrieval.search(ask(spark, "zzz"), chunks, docs, k=3))) == 3
    assert retrieval.search(ask(spark), chunks, docs).count() == 0


def test_evaluation(spark):
    docs, chunks = page(spark, ("Ranking", "Ranking", "gameplay", "how players are ranked"), ("Slider", "Slider", "gameplay", "curves"))
    found = retrieval.search(ask(spark, "ranking", "sliders", "slider"), chunks, docs, k=1)
    kind = "query_id int, category string, expected_document_ids array<string>, expected_chunk_ids array<string>"
    examples = spark.createDataFrame([(0, "a", ["Ranking"], []), (1, "b", ["Ranking"], []), (2, None, [], [])], kind)
    out = {r["category"]: (r["examples"], r["judged_examples"], r["matches"], r["retrieval_accuracy"]) for r in evaluation.summarize(evaluation.score_retrieval(examples, found)).collect()}
    assert out == {"a": (1, 1, 1, 1.0), "b": (1, 1, 0, 0.0), "uncategorized": (1, 0, 0, 0.0), None: (3, 2, 1, 0.5)}


def test_prompts_and_answers(spark):
    docs, chunks = page(spark, ("Ranking", "Ranking", "gameplay", "how players are ranked"))
    asked = ask(spark, "ranking", "ranks")
    prompts = prompting.build_prompts(asked, retrieval.search(asked.filter("query_id = 0"), chunks, docs), chunks)
    text = prompts.first()["prompt"]
    assert "Question: ranking" in text and "[1] Ranking" in text and "URL: https://x/Ranking" in text
    said = {r["query_id"]: r["answer"] for r in prompting.answer(asked, prompts, lambda p: f"{len(p) > 10} [1]").collect()}
    assert said == {0: "True [1]", 1: prompting.REFUSAL}
    assert prompting.answer(asked, prompts, lambda p: " ").filter(F.col("answer") == prompting.REFUSAL).count() == 2
