"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftwork.llm import annsearch, chat, cotraining, exactdedup, lexical, mixing, packing, prefixtrie, quality, secrets, sharding, simhash, urlfilter
from weftwork.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": lambda spark, d: quality.op1(documents(spark, d)),
        "op2_pack_sequences": lambda spark, d: packing.op2(documents(spark, d)),
        "op3_cotrained_quality": lambda spark, d: cotraining.op3(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op4_secret_scan": lambda spark, d: secrets.op4(documents(spark, d)),
        "op5_exact_dedup": lambda spark, d: exactdedup.op5(spark, f"{d}/documents.parquet"),
        "op6_url_filter": lambda spark, d: urlfilter.op6(spark.read.parquet(f"{d}/pages.parquet")),
        "op7_mix_sources": lambda spark, d: mixing.op7(documents(spark, d)),
        "op8_chat_format": lambda spark, d: chat.op8(spark.read.parquet(f"{d}/conversations.parquet")),
        "op9_simhash_classes": lambda spark, d: simhash.op9(documents(spark, d)),
        "op10_shard_shuffle": lambda spark, d: sharding.op10(documents(spark, d)),
        "op11_prefix_trie": lambda spark, d: prefixtrie.op11(spark.read.parquet(f"{d}/conversations.parquet")),
        "op12_nearest": lambda spark, d: annsearch.op12(spark.read.parquet(f"{d}/embeddings.parquet")),
        "op13_ranked_search": lambda spark, d: lexical.op13(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.SQL, "op5_exact_dedup": exactdedup.SQL, "op6_url_filter": urlfilter.SQL, "op7_mix_sources": mixing.SQL, "op8_chat_format": chat.SQL, "op11_prefix_trie": prefixtrie.SQL, "op13_ranked_search": lexical.SQL}
