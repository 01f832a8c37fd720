"""Registered queries of the analytics engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftwork.plans import index_queries, knowledge_queries, markdown_queries, retrieval_queries

Query = Callable[[SparkSession, str], DataFrame]
ALL = {**retrieval_queries.QUERIES, **knowledge_queries.QUERIES, **markdown_queries.QUERIES, **index_queries.QUERIES}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval of all passages over all documents."""
    return retrieval_queries.hybrid_search(spark, sf_dir)
