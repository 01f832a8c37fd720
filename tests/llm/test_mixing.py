"""Mixing: targets against water-filling step by step, copies against the targets."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.helpers import clashing, empty_docs, odd_docs, rows_of, words
from weftwork.llm import mixing
from weftwork.llm.common import documents


def brute_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, targets = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return targets | share
        for s in over:
            targets[s] = 3.0 * sizes[s]
            left -= targets[s]
            open_.remove(s)
    return targets


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(alphabet="abé", max_size=2)), st.integers(0, 5000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    told = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    expected = brute_targets(sizes)
    assert told.keys() == expected.keys()
    assert all(abs(told[s] - expected[s]) <= 1e-6 * max(1.0, expected[s]) for s in told)


def test_taken_words_come_near_targets(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    plan = mixing.mixing_plan(docs)
    for r in plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.1 * r["target"] + 4 * r["most"]
    assert plan.filter("taken > 3 * size").count() == 0
    assert rows_of(mixing.op7(docs)) == rows_of(mixing.op7(docs.repartition(5)))


def test_sizes(spark):
    docs = odd_docs(spark)
    told = Counter((r["doc_id"], r["size"]) for r in mixing.op7(docs).collect())
    assert told == Counter((r["doc_id"], len(words(r["text"]))) for r in docs.collect())


def test_mix_writes_what_the_plan_says(spark):
    docs = clashing(odd_docs(spark))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    planned = mixing.mixing_plan(docs).groupBy("doc_id").agg(F.sum("copies").alias("n"))
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["n"] for r in planned.collect()})


def test_many_sources_are_shuffled_not_broadcast(spark, monkeypatch):
    docs = documents(spark, SMALL)
    small = rows_of(mixing.op7(docs))
    monkeypatch.setattr(mixing, "if_small", lambda df: df)
    assert rows_of(mixing.op7(docs)) == small


def test_empty_table(spark):
    assert mixing.op7(empty_docs(spark)).collect() == [] and mixing.mix(empty_docs(spark)).collect() == []


@pytest.mark.parametrize("ids", ["null", "a third"])
def test_targets_are_met_without_ids_of_their_own(spark, ids):
    """Null ids, or one id for a third of the rows: rows are drawn apart by their texts, and equal rows one by one."""
    docs = documents(spark, "/root/testdata/sf0.01").filter("length(text) < 2000")
    own = F.lit(None).cast("long") if ids == "null" else F.when(F.col("doc_id") % 3 == 0, 7).otherwise(F.col("doc_id"))
    same = spark.range(600).select(own.alias("doc_id") if ids == "null" else F.lit(7).cast("long").alias("doc_id"), F.lit("four words in all").alias("text"), F.lit("en").alias("lang"), F.lit("equal").alias("source"), F.lit(17).cast("long").alias("n_chars")) if ids == "a third" else docs.limit(0)
    docs = docs.withColumn("doc_id", own).withColumn("source", F.concat(F.lit("s"), (F.col("n_chars") % 5).cast("string"))).union(same)
    rate = F.col("target") / F.col("source_size")
    fraction = rate - F.floor(rate)
    spread = F.sqrt(F.sum(F.col("size") * F.col("size") * fraction * (1 - fraction)))  # of independent draws
    for r in mixing.mixing_plan(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), spread.alias("spread")).collect():
        assert abs(r["taken"] - r["target"]) <= 4 * r["spread"] + 1 <= 0.5 * r["target"], r
    mixed = mixing.mix(docs)
    assert rows_of(mixed.groupBy("source").count()) == rows_of(mixing.mixing_plan(docs).groupBy("source").agg(F.sum("copies")))
    assert rows_of(mixing.op7(docs)) == rows_of(mixing.op7(docs.repartition(5)))


def test_equal_rows_in_steps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 4)
    rows = spark.createDataFrame([(1, "a", 2, "x", 11), (2, "b", 3, "y", 1)], "doc_id long, source string, size long, digest string, n long")
    assert sorted((r["doc_id"], r["rank"]) for r in mixing.numbered(rows).collect()) == [(1, i) for i in range(1, 12)] + [(2, 1)]
