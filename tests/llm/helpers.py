"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("row", "record", "fp", "keys", "counts", "digest", "file", "size", "copies", "label", "bucket", "slot", "h", "_source", "_text", "position")

PROSE = (
    "The morning light was on the hills and the river ran by the mill as it had for a long time, and those who came "
    "from the town in the valley would stop for a while to look at the water before they went on with the day. "
    "Not all of them knew that the old bridge, which was built with stone from the quarry, is to be closed this year."
)
LONG = " ".join(f"word{i % 977} and number {i}" for i in range(30_000))
ROWS = [
    (1, PROSE, "en", "a", len(PROSE)),
    (2, PROSE, "en", "a", len(PROSE)),
    (2, PROSE, "en", "a", len(PROSE)),
    (3, None, "en", "b", None),
    (4, "", None, "b", 0),
    (5, " \n\t ", "de", None, 4),
    (None, "only three words", "xx", None, 16),
    (None, None, None, None, None),
    (6, LONG, "en", "c", len(LONG)),
    (7, "same line\nsame line\nsame line\n" * 30, "fr", "c", 900),
    (8, "naïve café \U0001f600 日本語 " * 12, "es", "c", 200),
    (9, PROSE.upper(), "en", "a", len(PROSE)),
    (10, "x y z", "en", "", 5),
]


def odd_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def clashing(docs: DataFrame) -> DataFrame:
    """``docs`` with further columns of names that the operators use themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)
