"""Readers: Markdown trees as (rel_path, text) rows, tables of JSON lines, questions with expectations.

Every path may be in any store that Spark reads; files are listed and read by Spark, not by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftwork.functions.text import blank, strip

EXAMPLES = "category string, question string, expected_document_ids array<string>, expected_chunk_ids array<string>"
ENTITIES = "canonical string, aliases array<string>, sources array<string>, score double"


def qualified(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The path with its store's name, and whether it exists."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(where).toString(), store.exists(where)


def plain_path(c: Column) -> Column:
    """A file's address without escapes and with one slash behind the store's scheme."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^([A-Za-z0-9]+):/+", "$1:/")


def below(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """rel_path and text of the files below ``root`` whose name fits the pattern; one row a file."""
    top = spark.range(1).select(plain_path(F.lit(qualified(spark, root)[0].replace("%", "%25"))).alias("top")).first()["top"].rstrip("/")
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    at = plain_path(files.metadataColumn("_metadata")["file_path"])
    return files.select(F.substring(at, len(top) + 2, 1 << 16).alias("rel_path"), F.col("value").alias("text"))


def markdown_files(spark: SparkSession, root: str, lang: str = "en", year: str | None = None) -> DataFrame:
    """Pages and news posts of a corpus: rel_path and text; with a ``year`` that year's news posts alone, no other folder is listed.

    Pages are the files ``<lang>.md`` below ``wiki/`` and named from there; news posts are the ``.md`` files below
    ``news/`` and named from ``root``. Either folder may be missing; without both the corpus does not exist.
    """
    found = []
    folders = [("wiki", f"{lang}.md", ""), ("news", "*.md", "news/")] if year is None else [(f"news/{year}", "*.md", f"news/{year}/")]
    for folder, pattern, prefix in folders:
        place = f"{root.rstrip('/')}/{folder}"
        if qualified(spark, place)[1]:
            files = below(spark, place, pattern)
            found.append(files.select(F.concat(F.lit(prefix), F.col("rel_path")).alias("rel_path"), "text"))
    if not found:
        raise FileNotFoundError(f"no corpus at {root}: no {' or '.join(folder for folder, *_ in folders)} there")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table of JSON lines; a missing one is empty."""
    return spark.read.schema(schema).json(path) if qualified(spark, path)[1] else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, ENTITIES)


def lines_without(spark: SparkSession, path: str, field: str, most: int = 10) -> list[str]:
    """The first places, as line and file, where a file of JSON lines has a record whose ``field`` is blank."""
    whole = spark.read.format("binaryFile").load(path)
    lines = whole.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("at", "line")).filter(~blank(F.col("line")))
    bad = lines.filter(blank(F.get_json_object("line", f"$.{field}"))).orderBy("path", "at").limit(most)
    return [f"line {r['at'] + 1} in {r['path']}" for r in bad.collect()]


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, category and expectations of a file of JSON lines; blank questions are an error.

    query_id is the question's text: equal questions are one.
    """
    if not qualified(spark, path)[1]:
        raise FileNotFoundError(f"no evaluation questions at {path}")
    rows = spark.read.schema(EXAMPLES).json(path)
    if not rows.filter(blank(F.col("question"))).isEmpty():
        raise ValueError("no question on " + "; ".join(lines_without(spark, path, "question")))
    empty = F.array().cast("array<string>")
    question = strip(F.col("question"))
    return rows.select(
        question.alias("query_id"), question.alias("query"), F.when(blank(F.col("category")), F.lit("uncategorized")).otherwise(strip(F.col("category"))).alias("category"),
        F.coalesce("expected_document_ids", empty).alias("expected_document_ids"), F.coalesce("expected_chunk_ids", empty).alias("expected_chunk_ids"),
    )
