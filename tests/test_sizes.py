"""What must not grow with the tables: broadcasts, batches, repeated work."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from weftwork import storage
from weftwork.operators import entities, extraction, maxscore, retrieval, structure, terms
from weftwork.operators.vectors import largest_products
from weftwork.vocab import Vocabulary

from .test_retrieval import ask, page


def test_named_twice_is_one_row(spark):
    named = spark.createDataFrame([("Big ring", "a", "Big ring")] * 50 + [("Ring", "b", None)], "raw string, source string, hint string")
    assert terms.add_terms(named).count() == terms.add_terms(named.distinct()).count() == 5


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([("Part/1", "Ring", 1), ("Part/2", "Rings", 2), ("Part/3", "Ring", 3)], "page_id string, title string, ordinal long")
    asked = spark.createDataFrame([("ring", "Part/3"), ("rings", ""), ("none", ""), ("part 2", "Part/2")], "name string, document_id string")
    few = {tuple(r) for r in entities.resolve_targets(asked, entities.document_index(pages)).collect()}
    monkeypatch.setattr(storage, "FEW", 0)
    made = entities.resolve_targets(asked, entities.document_index(pages))
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in made.collect()} == few and ("ring", "Part/3", "Part/3", "Ring", "source_title") in few


def test_dense_scores_meet_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)] + [(100 + i, [5.0, 1.0, 1.0]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(q, [float(q), 1.0, 0.5]) for q in range(-3, 4)], "query_id long, query_embedding array<float>")
    plain = {(q["query_id"], i) for q in asked.collect() for _, i in sorted((-sum(a * b for a, b in zip(v, q["query_embedding"], strict=True)), i) for i, v in rows)[:5]}
    made = retrieval.dense_scores(asked, vectors, 5)
    assert {(r["query_id"], r["chunk_id"]) for r in made.collect()} == plain
    assert {(r["query_id"], r["chunk_id"]) for r in largest_products(asked, vectors, 5, block_rows=9).collect()} == plain
    assert "CartesianProduct" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    odd = vectors.limit(3).union(spark.createDataFrame([(999, None)], vectors.schema))
    assert len(retrieval.dense_scores(asked, odd, 4).filter("chunk_id = 999 and dense_score is null").collect()) == 7


def test_overlaps_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "ring ring key"), (2, "key"), (2, "ring"), (None, "key key"), (3, None)], "id long, text string")
    asked = spark.createDataFrame([(7, "ring", 2), (7, "key", 1), (8, "key", 5), (9, "none", 1), (9, None, 1)], "query_id long, term string, n long")
    made = retrieval.overlap(asked, rows, "id", F.col("text"))
    assert {tuple(r) for r in made.collect()} == {(7, 1, 3), (8, 1, 1), (7, 2, 2), (8, 2, 1), (7, None, 1), (8, None, 2)}
    once = retrieval.overlap(asked, rows.filter("id <> 2"), "id", F.col("text"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString() and once.count() == 2
    assert {tuple(r) for r in maxscore.overlaps(asked, maxscore.term_bags(rows.filter("id <> 2"), "id", F.col("text")), "id", query_terms=2).collect()} == {(7, 1, 3), (8, 1, 1)}


def test_bags_come_in_small_batches(spark):
    seen = maxscore.term_bags(spark.range(3000).selectExpr("id", "'a ring' as text").coalesce(1), "id", F.col("text"))
    sizes = [r["n"] for r in seen.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in maxscore.sliced(bs)), "n long").collect()]
    assert sum(sizes) == 3000 and max(sizes) <= maxscore.SLICE


def test_pages_are_dealt_by_their_characters(spark, monkeypatch):
    monkeypatch.setattr(structure, "TASK_CHARS", 1000)
    pages = spark.range(100).selectExpr("concat('p/', id) as rel_path", "concat('# a', repeat('\\nline', 40)) as body")
    lines = structure.section_lines(structure.page_lines(pages))
    assert lines.rdd.getNumPartitions() == 21 and lines.count() == 4100
    plan = lines._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_search_writes_neither_texts_nor_pairs(spark, monkeypatch):
    pages = [("A", "A ring", "help", "ring text"), ("A/B", "B key", "general", "key key <b>"), ("A/B/C", "ring", "general", "1. open the key"), ("D", "open", "help", "fps"), *[(f"E/{i}", "Same", "general", "same key") for i in range(30)]]
    docs, chunks = page(spark, *pages)
    asked = ask(spark, "ring", "what is key access open", "fps is low, fix", "zzz", "same", "general key key", "")
    near = spark.createDataFrame([(0, "D::article", 0.5), (4, "E/29::article", -3.0), (6, "A::article", 0.25)], "query_id int, chunk_id string, dense_score double")
    vocab = Vocabulary(document_hints={"performance": {"A/B": 3.0, "D": 1.0}, "troubleshooting": {"D": 2.0, "none": 5.0}})
    shown = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["title"], *(round(r[c], 9) for c in ("score", "dense_score", "keyword_score", "entity_score", "document_score"))) for r in df.collect())
    expected = [shown(retrieval.joined_search(asked, chunks, docs, dense=dense, vocab=vocab)) for dense in (None, near)]
    written, write = [], retrieval.materialized
    monkeypatch.setattr(retrieval, "materialized", lambda df: written.append(df) or write(df))
    assert [shown(retrieval.search(asked, chunks, docs, dense=dense, vocab=vocab)) for dense in (None, near)] == expected
    assert written and all("text" not in df.columns and "sections" not in df.columns for df in written)
    assert max(df.count() for df in written if "chunk_id" in df.columns) < 7 * chunks.count() // 3
    monkeypatch.setattr(retrieval, "QUESTIONS", 2)
    assert shown(retrieval.search(asked, chunks, docs, dense=near, vocab=vocab)) == expected[1]
    assert shown(retrieval.search(asked, chunks.union(chunks.limit(1)), docs)) == shown(retrieval.joined_search(asked, chunks.union(chunks.limit(1)), docs))


def test_matches_are_counted_where_they_lie(spark):
    _, chunks = page(spark, ("A", "A ring", "help", "x"), ("A/B", "B key", "general", "y"), *[(f"E/{i}", "Same", "general", "z") for i in range(30)])
    asked = ask(spark, "ring", "section key", "same section", "zzz", "")
    shown = lambda df: sorted(map(tuple, df.collect()))
    plain = lambda rows: shown(retrieval.keyword_candidates(asked, retrieval.postings(rows)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_chunk")))
    made = retrieval.keyword_matches(asked, chunks)
    assert shown(made) == plain(chunks) and len(plain(chunks)) == 3
    assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    assert shown(retrieval.keyword_matches(asked, chunks.union(chunks.limit(5)))) == plain(chunks)


def test_extraction_takes_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    extraction.register(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == storage.BATCH_BYTES
    spark.createDataFrame([("1", "1", "The ring the"), ("2", "2", None)], "document_id string, chunk_id string, text string").createOrReplaceTempView("small_texts")
    assert [tuple(r) for r in spark.sql("SELECT document_id, text, start FROM extract_entities(TABLE(small_texts), map('the', 'article')) ORDER BY start").collect()] == [("1", "The", 0), ("1", "the", 9)]


def test_lines_are_made_and_sorted_once(spark, monkeypatch):
    made, make = [], structure.page_lines
    monkeypatch.setattr(structure, "page_lines", lambda pages: made.append(F.monotonically_increasing_id()) or make(pages))
    table = "\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    files = spark.createDataFrame([("p/en.md", f"# T{table}{table}\ntext[^n]\n\n## U{table}\n[^n]: note\n"), ("q/en.md", f"x{table}y")], "rel_path string, text string")
    lines = structure.section_lines(make(files.select("rel_path", F.col("text").alias("body"))))
    marked = structure.table_marks(structure.content_lines(lines))
    plan = marked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Sort [") <= 3
    numbers = {(r["rel_path"], r["section"], r["table"]) for r in marked.filter("start is not null").collect()}
    assert numbers == {("p/en.md", 1, 1), ("p/en.md", 1, 2), ("p/en.md", 2, 1), ("q/en.md", 0, 1)}
    docs = {r["page_id"]: (r["section_count"], r["table_count"], r["citation_count"]) for r in structure.parse_pages(files).collect()}
    assert docs == {"p": (2, 3, 1), "q": (1, 1, 0)} and made and len(made) == 1
