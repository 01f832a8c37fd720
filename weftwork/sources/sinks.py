"""Writers: Parquet tables, JSON lines, review files by decision, one-row reports. Spark's commit makes each write whole or absent."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> int:
    """Parquet; gives the number of rows, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def write_records(df: DataFrame, path: str) -> int:
    """JSON lines without null fields; gives the number of rows."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_review(df: DataFrame, path: str) -> None:
    """CSV with a header, a folder per decision, in one pass."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("decision").csv(path)


def write_report(df: DataFrame, path: str) -> dict:
    """A report of one row as pretty JSON, written through Spark so that any store will do; gives the report."""
    report = json.loads(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"])
    write_text(df.sparkSession, json.dumps(report, ensure_ascii=False, indent=2), path)
    return report


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
