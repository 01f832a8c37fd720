"""The driver's tables as the engine's inputs: documents as pages and chunks, passages as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators.chunking import build_chunks

STRINGS = "array<string>"
#: Tables of long texts, which are worth a shuffle where they would be read by one task.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; one in fewer files than cores is dealt over all of them, since a file may be one row group."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, rows.columns[0]) if name in TEXTS and len(rows.inputFiles()) < cores else rows


def pages_of(documents: DataFrame) -> DataFrame:
    """Each document as a page lang/source/id with one section, titled by its first two plain words."""
    none = F.lit(None).cast("string")
    title = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), "^([A-Za-z]+ [A-Za-z]+)", 1), F.lit("")), F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    page = F.concat_ws("/", "lang", F.col("source"), F.col("doc_id").cast("string"))
    section = F.struct(
        F.lit("body").alias("section_id"), F.lit("Body").alias("title"), F.array(F.lit("Body")).alias("heading_path"), F.coalesce("text", F.lit("")).alias("text"),
        F.array().cast("array<struct<headers:array<string>,rows:array<array<string>>>>").alias("tables"), F.array().cast("array<struct<source:string,expression:string>>").alias("formulae"),
    )
    return documents.select(
        F.lit("wiki").alias("source"), page.alias("page_id"), page.alias("document_id"), F.concat(page, F.lit(".md")).alias("repo_rel_path"), F.concat(F.lit("https://example.org/"), page).alias("url"),
        title.alias("title"), F.array("lang", "source").alias("tags"), F.array().cast(STRINGS).alias("series_tags"), F.col("lang").alias("domain"), F.lit("general").alias("subculture"), F.col("source").alias("topic"), none.alias("slug"),
        none.alias("year"), none.alias("series_primary"), none.alias("preview_paragraph"), none.alias("date_iso"), none.alias("filename_date"), F.array().cast(STRINGS).alias("style_issues"),
        F.array(section).alias("sections"), F.array(F.lit("Body")).alias("section_parts"), F.array().cast("array<struct<citation_id:string,text:string>>").alias("citations"), F.col("doc_id").alias("ordinal"),
        F.array().cast("array<struct<link_text:string,target_page_id:string>>").alias("link_edges"),
    )


def chunks_of(documents: DataFrame) -> DataFrame:
    return build_chunks(pages_of(documents))


def questions(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def linked_pages(pages: DataFrame) -> DataFrame:
    """Web pages as documents with the links of their whole HTML."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">[^<]*</a>'), F.lit(0))
    edge = lambda a: F.struct(
        F.regexp_extract(a, '>([^<]*)<', 1).alias("link_text"), F.regexp_extract(a, 'href="/?([^"]*)"', 1).alias("target_page_id"), F.regexp_extract(a, 'href="([^"]*)"', 1).alias("url_raw"),
        F.lit(None).cast("string").alias("url_resolved"), F.lit("wiki_article").alias("link_type"), F.lit(None).cast("string").alias("target_anchor"), F.lit("body").alias("source_section_id"),
        F.array().cast(STRINGS).alias("source_heading_path"), F.lit("").alias("context"),
    )
    return pages.select(
        F.lit("wiki").alias("source"), F.col("page_id").cast("string").alias("document_id"), F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("title"), F.col("url").alias("repo_rel_path"),
        F.col("page_id").alias("ordinal"), F.transform(F.coalesce(found, F.array().cast(STRINGS)), edge).alias("link_edges"),
    )
