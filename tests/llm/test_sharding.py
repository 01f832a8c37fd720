"""Sharding: placement by key, gapless slots, real shuffles, written shards."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tests.conftest import SMALL
from tests.llm.helpers import clashing, empty_docs, odd_docs, rows_of
from weftwork.llm import sharding
from weftwork.llm.common import documents, shared_path


def slots(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append((r["slot"], r["doc_id"]))
    return out


def test_documents(spark):
    for docs in (documents(spark, SMALL), odd_docs(spark)):
        rows = sharding.op10(docs).collect()
        size = lambda t: len((t or "").encode()) + 1
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        for shard, placed in slots(rows).items():
            assert 0 <= shard < 8 and sorted(s for s, _ in placed) == list(range(len(placed)))
        for r in rows:
            assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)


def test_shards_are_even_and_one_more_takes_its_share(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', int(id % 50)) AS text")
    rows = sharding.op10(docs).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(counts) == 8 and max(counts.values()) < 1.1 * 2500
    assert abs(sum(r["grown_shard"] == 8 for r in rows) - 20_000 / 9) < 300


def test_order_is_shuffled_and_reruns_agree(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    for size in (sharding.BUCKET_BYTES, 20_000):
        plan = lambda d: rows_of(sharding.shard_plan(d, bucket_bytes=size))  # noqa: E731, B023
        rows = plan(docs)
        assert rows == plan(docs.repartition(5))
        for conf, values in (("spark.sql.adaptive.enabled", ("false", "true")), ("spark.sql.shuffle.partitions", ("1", "3", "7"))):
            before = spark.conf.get(conf)
            try:
                for value in values:
                    spark.conf.set(conf, value)
                    assert plan(docs) == rows
            finally:
                spark.conf.set(conf, before)
    for placed in slots(sharding.op10(docs).collect()).values():
        ids = [i for _, i in sorted(placed)]
        ups = sum(a < b for a, b in zip(ids, ids[1:], strict=False))
        assert 0.35 * len(ids) < ups < 0.65 * len(ids)


def chained(*values: tuple[int, int]) -> int:
    """Spark's xxhash64 of whole numbers (value, bytes): each is hashed with the hash before it as seed."""
    h = 42
    for value, n in values:
        h = xxhash.xxh64_intdigest(value.to_bytes(n, "little", signed=True), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def fisher_yates(n: int, draws: np.random.RandomState) -> list[int]:
    """Inside out, with whole numbers below a bound as the JVM's Mersenne Twister draws them."""

    def below(bound: int) -> int:
        while True:
            bits = int(draws.randint(0, 1 << 32, dtype=np.uint32)) >> 1
            if bound & (bound - 1) == 0:
                return bound * bits >> 31
            if bits - bits % bound + bound - 1 < 1 << 31:
                return bits % bound

    out: list[int] = []
    for i in range(n):
        j = below(i + 1)
        out.append(out[j] if j < i else i)
        out[j] = i
    return out


@pytest.mark.parametrize("bucket_bytes", [sharding.BUCKET_BYTES, 50_000])
def test_plain_version(spark, bucket_bytes):
    """Shards, buckets and slots, all worked out again in plain Python."""
    docs = documents(spark, SMALL)
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    rows = [(i, zlib.crc32(t), len(t) + 1) for i, t in texts]
    buckets = max(1, -(-sum(n + sharding.ROW_BYTES for *_, n in rows) // (8 * bucket_bytes)))
    shard = lambda i, n: max((chained((42, 4), (k, 4), (i, 8)), k) for k in range(n))[1]
    held = defaultdict(list)
    for i, crc, n in rows:
        bucket = chained((43, 4), (i, 8), (crc, 8), (n, 8)) % buckets if buckets > 1 else 0
        held[shard(i, 8), bucket].append((i, crc, n, shard(i, 9)))
    wanted, starts = [], Counter()
    for at, bucket in sorted(held):
        ordered = sorted(held[at, bucket])
        seed = 42 + at * buckets + bucket
        for k, j in enumerate(fisher_yates(len(ordered), np.random.RandomState([seed >> 32, seed & 0xFFFFFFFF]))):
            i, crc, n, grown = ordered[j]
            wanted.append((i, n, crc, at, grown, bucket, starts[at] + k))
        starts[at] += len(ordered)
    got = sharding.shard_plan(docs, bucket_bytes=bucket_bytes).select("doc_id", "size", "text_crc32", "shard", "grown_shard", "bucket", "slot").collect()
    assert (buckets > 1) == (bucket_bytes == 50_000) and sorted(map(tuple, got)) == sorted(wanted)


def test_rows_that_are_alike_scatter(spark):
    docs = spark.range(4000).selectExpr("CAST(IF(id % 3 = 0, NULL, id) AS LONG) AS doc_id", "'one text' AS text")
    plan = sharding.shard_plan(docs, bucket_bytes=10_000).collect()
    assert max(Counter((r["shard"], r["bucket"]) for r in plan if r["doc_id"] is None).values()) < 400
    for placed in slots(plan).values():
        assert sorted(s for s, _ in placed) == list(range(len(placed)))


def test_many_buckets(spark):
    docs = documents(spark, SMALL)
    plan = sharding.shard_plan(docs, bucket_bytes=5_000).collect()
    assert sum(1 for _, placed in slots(plan).items() if sorted(s for s, _ in placed) == list(range(len(placed)))) == len({r["shard"] for r in plan})
    few = {r["doc_id"]: r["shard"] for r in sharding.shard_plan(docs).collect()}
    assert few == {r["doc_id"]: r["shard"] for r in plan}


def test_copies_share_no_bucket_beyond_chance(spark):
    """A third of all rows with one text: the ids scatter them."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "'same text' AS text")
    counts = Counter(r["shard"] for r in sharding.op10(docs).collect())
    assert max(counts.values()) < 1.25 * 500


def test_written_records_come_back(spark):
    docs, path = clashing(odd_docs(spark)), shared_path(spark, "shards")
    sharding.write_shards(docs, path, shards=3)
    back = spark.read.parquet(path)
    assert rows_of(back.select("record.*")) == rows_of(docs)
    for placed in slots(back.select("shard", "slot", "record.doc_id").collect()).values():
        assert sorted(s for s, _ in placed) == list(range(len(placed)))


def test_empty_table(spark):
    assert sharding.op10(empty_docs(spark)).collect() == []
    path = shared_path(spark, "shards")
    sharding.write_shards(empty_docs(spark), path)
