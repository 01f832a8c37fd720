"""One local session for all tests, and DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(root / "shared"))
        .config("spark.local.dir", str(root / "local"))
        .config("spark.sql.warehouse.dir", str(root / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    yield con
    con.close()


def shown(value) -> str:
    """A value as text that both engines share: nine digits of floating-point numbers."""
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(shown, value)) + "]"
    return str(value)


def same_rows(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    """Both results have the same columns and the same rows, in any order."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted(tuple(shown(row[i]) for i in at) for row in result.fetchall())
    assert sorted(tuple(map(shown, row)) for row in df.select(*[f"`{c}`" for c in columns]).collect()) == expected
