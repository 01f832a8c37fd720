"""Exact dedup by a stream: groups, colliding digests, batches, later files."""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import clashing, empty_docs, odd_docs
from weftwork.llm import exactdedup
from weftwork.llm.common import located, shared_path


def expected(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and how many rows stay."""
    text = lambda r: r["text"] or ""
    sizes = Counter(map(text, rows))
    largest: dict[str, int | None] = {}
    for r in rows:
        known = [x for x in (largest.get(text(r)), r["doc_id"]) if x is not None]
        largest[text(r)] = max(known) if known else None
    told = [(r["doc_id"], largest[text(r)], sizes[text(r)], hashlib.sha256(text(r).encode()).hexdigest()) for r in rows]
    return sorted(told, key=repr), len(sizes)


def check(spark, docs, **options):
    path = shared_path(spark, "dedup-test")
    docs.write.parquet(path)
    rows = docs.collect()
    out = exactdedup.exact_duplicates(spark, path, **options)
    told, groups = expected(rows)
    found = out.collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in found), key=repr) == sorted((t[:3] for t in told), key=repr)
    kept = [r for r in found if r["kept"]]
    assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    path = shared_path(spark, "dedup-test")
    docs.write.parquet(path)
    out = exactdedup.op5(spark, path).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=repr) == expected(docs.collect())[0]
    check(spark, clashing(docs))


def test_equal_digests_of_different_texts_are_told_apart(spark):
    check(spark, odd_docs(spark), digest=lambda text: F.substring(F.sha2(text, 256), 1, 1))
    check(spark, odd_docs(spark), digest=lambda text: F.lit("same"))


def test_groups_over_batches(spark):
    """One file a batch: state carries groups from one batch to the next."""
    docs = spark.range(400).select("id", F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text")).withColumnRenamed("id", "doc_id")
    check(spark, docs.repartition(6), maxFilesPerTrigger=1)


def test_state_goes_on(spark):
    """A later call with the same state takes only new files, and nothing expires."""
    path, state = shared_path(spark, "dedup-test"), shared_path(spark, "dedup-state")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    first.write.parquet(path)
    exactdedup.stream_state(spark, path, state)
    spark.createDataFrame([(4, "b"), (5, "c")], first.schema).write.mode("append").parquet(path)
    exactdedup.stream_state(spark, path, state)
    told = {r["keep_id"]: r["n"] for r in exactdedup.read_state(spark, state).collect()}
    assert told == {3: 2, 4: 2, 5: 1}


def test_drop(spark):
    docs = clashing(odd_docs(spark))
    kept = exactdedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter(r["text"] or "" for r in rows) == Counter(dict.fromkeys({r["text"] or "" for r in docs.collect()}, 1))
    assert exactdedup.drop_exact_duplicates(empty_docs(spark)).collect() == []
    same_digest = exactdedup.drop_exact_duplicates(docs, digest=lambda text: F.lit("same"))
    assert sorted(r["text"] or "" for r in same_digest.collect()) == sorted(r["text"] or "" for r in rows)


def test_rows_of_files_and_others_keep_their_place(spark):
    """In place where rows have one of their own; written first where an explode or a join has doubled them."""
    path = shared_path(spark, "rows-test")
    odd_docs(spark).write.parquet(path)
    read = spark.read.parquet(path)
    doubled = read.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("nth"))
    joined = read.join(spark.read.parquet(path).select(F.col("text").alias("text2"), F.col("doc_id").alias("doc_id2")), F.col("doc_id") == F.col("doc_id2"))
    for docs, in_place in ((read, True), (read.filter("doc_id > 2"), True), (doubled, False), (joined, False), (odd_docs(spark), False)):
        rows = located(docs)
        assert all((path in r["file"]) == in_place for r in rows.select("file").distinct().collect())
        assert rows.select("file", "row").distinct().count() == docs.count()
        assert exactdedup.drop_exact_duplicates(docs).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_empty_table(spark):
    path = shared_path(spark, "dedup-test")
    empty_docs(spark).write.parquet(path)
    assert exactdedup.op5(spark, path).collect() == []
