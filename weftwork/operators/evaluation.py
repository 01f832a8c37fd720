"""Hit rates of retrieved chunks and documents against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_retrieval(examples: DataFrame, results: DataFrame) -> DataFrame:
    """``examples(query_id, category, expected_document_ids, expected_chunk_ids)`` with their hits in ``results(query_id, rank, chunk_id, document_id)``."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id")))
    got = results.groupBy("query_id").agg(ranked.alias("r"))
    empty = F.array().cast("array<string>")
    rows = examples.join(got, "query_id", "left").select(
        "query_id", F.coalesce("category", F.lit("uncategorized")).alias("category"), F.coalesce("expected_document_ids", empty).alias("documents"), F.coalesce("expected_chunk_ids", empty).alias("chunks"),
        F.coalesce(F.col("r.chunk_id"), empty).alias("top_chunk_ids"), F.coalesce(F.col("r.document_id"), empty).alias("top_document_ids"),
    )
    chunk, doc = F.arrays_overlap("chunks", "top_chunk_ids"), F.arrays_overlap("documents", "top_document_ids")
    return rows.withColumn("has_expectation", ((F.size("chunks") > 0) | (F.size("documents") > 0)).cast("int")).withColumn("chunk_match", chunk.cast("int")).withColumn("document_match", doc.cast("int")).withColumn("matched", (chunk | doc).cast("int"))


def summarize(scores: DataFrame) -> DataFrame:
    """Per category and, where category is null, in all: examples, judged_examples, matches, retrieval_accuracy; one rollup."""
    judged, matches = F.sum("has_expectation"), F.sum("matched")
    return scores.rollup("category").agg(
        F.count(F.lit(1)).alias("examples"), judged.alias("judged_examples"), matches.alias("matches"), F.coalesce(F.try_divide(matches, judged), F.lit(0.0)).alias("retrieval_accuracy")
    )


def per_question(examples: DataFrame, results: DataFrame) -> DataFrame:
    """score_retrieval() with the question and top_sources: the results in order of rank, each with its scores."""
    scores = ("score", "dense_score", "keyword_score", "entity_score", "document_score")
    source = F.struct("rank", "chunk_id", "document_id", "title", *[F.round(c, 6).alias(c) for c in scores])
    top = results.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("top_sources"))
    named = examples.select("query_id", F.col("query").alias("question"))
    return score_retrieval(examples, results).join(named, "query_id").join(top, "query_id", "left").withColumn("top_sources", F.coalesce("top_sources", F.array()))


def texts_with_passages(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """doc, query_id of each text of ``texts(doc, body)`` that holds a passage of ``passages(query_id, query)`` as it is.

    A passage's inner words stand as words in a text that holds it: they meet by the longest of them, in an equi-join,
    and what meets is compared. Passages of fewer than three words have no inner one and are compared with all
    texts; empty ones are left out.
    """
    words = lambda text: F.split(text, r"\s+")
    inner = F.slice(words(F.col("query")), F.lit(2), F.greatest(F.size(words(F.col("query"))) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = passages.filter("query <> ''").select("query_id", "query", longest.alias("word"))
    held = texts.select("doc", "body", F.explode(F.array_distinct(words(F.col("body")))).alias("word"))
    keys = keyed.filter("word is not null")
    few = keys.select("word").distinct()
    met = held.join(few, "word").join(keys, "word").filter(F.contains("body", "query")).select("doc", "query_id")
    short = texts.join(keyed.filter("word is null").drop("word"), F.contains("body", "query")).select("doc", "query_id")
    return met.union(short)
