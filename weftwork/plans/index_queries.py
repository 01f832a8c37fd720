"""Queries about the index: changes between two states, filters by bitmaps, extraction as a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators import bitmaps, extraction, ordering, snapshots, vectors
from weftwork.plans.tables import table
from weftwork.storage import materialized

#: Orders of a later state: some are gone, some have another price, some are new.
GONE, CHANGED, NEW = 7, 5, 11
SHIFT = 1_000_000_000


def order_changes(spark: SparkSession, d: str) -> DataFrame:
    """What has changed between all orders and a later state of them, by content."""
    orders = table(spark, d, "orders")
    price = F.when(F.col("o_orderkey") % CHANGED == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice")
    others = [c for c in orders.columns if c not in ("o_orderkey", "o_totalprice")]
    later = orders.filter(F.col("o_orderkey") % GONE != 0).select("o_orderkey", price, *others)
    later = later.unionByName(orders.filter(F.col("o_orderkey") % NEW == 0).withColumn("o_orderkey", F.col("o_orderkey") + SHIFT))
    state = lambda df: df.select(F.col("o_orderkey").alias("key"), snapshots.content_of(*sorted(orders.columns)).alias("content"))
    return snapshots.changes(state(orders), state(later))


ORDER_CHANGES = f"""
SELECT o_orderkey AS key, 'delete' AS change FROM orders WHERE o_orderkey % {GONE} = 0
UNION ALL SELECT o_orderkey, 'update' FROM orders WHERE o_orderkey % {GONE} <> 0 AND o_orderkey % {CHANGED} = 0
UNION ALL SELECT o_orderkey + {SHIFT}, 'insert' FROM orders WHERE o_orderkey % {NEW} = 0
"""

LANGS, SOURCES = ["en", "fr"], ["src1", "src2", "src7", "src13"]


def _chosen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their fields, and the bitmaps of those in two languages and four sources that are not short."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long").alias("size"))
    index = materialized(bitmaps.bitmap_index(docs, "doc_id", ["lang", "source", "size"]))
    return docs, bitmaps.selected(index, {"lang": LANGS, "source": SOURCES, "size": ["medium", "long"]})


def filtered_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents that three fields' filters leave, by bitmaps."""
    docs, chosen = _chosen(spark, d)
    return bitmaps.filtered(docs, "doc_id", chosen).select("doc_id", "lang", "source", "size")


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_FILTERED = f"""f AS (SELECT doc_id, lang, source, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS size FROM documents
  WHERE lang IN ({_in(LANGS)}) AND source IN ({_in(SOURCES)}))"""
FILTERED_DOCUMENTS = f"WITH {_FILTERED} SELECT doc_id, lang, source, size FROM f WHERE size <> 'short'"


def filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every hundredth, among the vectors of documents that the filters leave; exact."""
    _, chosen = _chosen(spark, d)
    rows = table(spark, d, "embeddings")
    kept = bitmaps.filtered(rows, "vec_id", chosen).select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return vectors.nearest_to(asked, kept, 5, missed=0).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


FILTERED_TOPK = f"""
WITH {_FILTERED},
s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v JOIN f ON f.doc_id = v.vec_id WHERE q.vec_id % 100 = 0 AND size <> 'short')
SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s) WHERE r <= 5
"""

NAMES = {"the": "article", "that": "pronoun", "les": "article", "und": "conjunction"}


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """Known words in all documents, by the table function: mentions of each in each document."""
    extraction.register(spark)
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text")).createOrReplaceTempView("weftwork_texts")
    names = ", ".join(f"'{k}', '{v}'" for k, v in NAMES.items())
    return spark.sql(f"SELECT CAST(document_id AS BIGINT) AS doc_id, label, count(*) AS n, CAST(min(start) AS BIGINT) AS first FROM extract_entities(TABLE(weftwork_texts), map({names})) GROUP BY document_id, label")


EXTRACTED = "\nUNION ALL\n".join(
    f"SELECT doc_id, '{label}' AS label, sum(n)::BIGINT AS n, min(first)::BIGINT AS first FROM ("
    + " UNION ALL ".join(
        rf"SELECT doc_id, len(regexp_extract_all(t, '(?:^|[^\p{{L}}\p{{N}}_])(?i:{name})(?:$|[^\p{{L}}\p{{N}}_])')) AS n, length(regexp_extract(text, '^((?s:.*?)(?:^|[^\p{{L}}\p{{N}}_]))(?i:{name})(?:$|[^\p{{L}}\p{{N}}_])', 1)) AS first FROM (SELECT doc_id, text, regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') AS t FROM documents WHERE text IS NOT NULL) WHERE n > 0"
        for name, given in NAMES.items()
        if given == label
    )
    + ") GROUP BY doc_id"
    for label in sorted(set(NAMES.values()))
)



def order_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of every order by price, the highest first, numbered without a task that sees all."""
    placed = ordering.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey")
    return placed.select("o_orderkey", F.col("nth").cast("long").alias("nth"))


ORDER_PLACES = "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders"

QUERIES = {
    "order_places": (order_places, ORDER_PLACES),
    "order_changes": (order_changes, ORDER_CHANGES),
    "filtered_documents": (filtered_documents, FILTERED_DOCUMENTS),
    "filtered_topk": (filtered_topk, FILTERED_TOPK),
    "extract_entities_udtf": (extracted, EXTRACTED),
}
