"""The prefix trie against a plain one, built turn by turn."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.helpers import CLASHES, rows_of
from weftwork.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def truncated(c: int, family: int) -> int:
    return c - int(abs(c) % family) * (1 if c >= 0 else -1)


def plain(rows: list[tuple], family: int = 5, heads: int = 9) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % heads
        path = turns.get(truncated(c, family), [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, held in members.items():
        own_saved = (len(held) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own_saved
            leaves[node[:d]] += not children[node]
    return sorted(
        (min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children[node], leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, held in members.items()
    )


def told(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


ODD = [
    (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, None, None, None), (2, 0, "user", ""), (5, 0, "user", "x"), (5, 1, "assistant", "é\U0001f600"),
    (6, 0, "user", "q"), (7, 0, "user", "q"), (None, 0, "user", "nobody"), (-3, 0, "user", "x"), (-5, 0, "user", "x"), (-5, 1, None, "long " * 20_000),
    (8, 0, "user", "x"), (8, 1, "assistant", "é\U0001f600"), (10, 0, "user\nx", ""), (11, 0, "user", "\nx"), (9, 3, "user", "same"), (9, 3, "user", "same"), (9, 3, "user", "same"),
]


@pytest.mark.parametrize("at_once", [0, 1 << 16])
def test_odd_tables(spark, at_once):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert told(prefixtrie.prefix_trie(df, at_once=at_once)) == plain(ODD)


def test_rounds_of_messages(spark):
    """Nested conversations: each a first part of the next, so that the tree of chains is as high as they are many."""
    rows = [(c * 5, t, "user", f"turn {t}") for c in range(1, 9) for t in range(10 + c)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(prefixtrie.prefix_trie(df, at_once=0)) == told(prefixtrie.prefix_trie(df)) == plain(rows)


def test_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.select("*", *[F.lit(c).alias(c) for c in (*CLASHES, "pos", "d1", "k1", "one", "head", "part", "at")])
    assert told(prefixtrie.op11(clashing)) == plain(rows) == told(prefixtrie.op11(df.repartition(7)))


def test_a_key_over_many_ranges(spark):
    """One conversation holds nearly all rows and is split over ranges; sums and places go on from range to range."""
    rows = [(3, t, "user", f"t{t}") for t in range(3000)] + [(c, 0, "user", "hello") for c in range(4, 30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    numbered = prefixtrie.running(df.filter("conv_id = 3").select("conv_id", "turn"), "conv_id", ["turn"], {"upto": "turn"}, {"mixed": "turn"}).orderBy("turn").collect()
    mixed = 0
    for t, r in enumerate(numbered):
        mixed ^= t
        assert (r["upto"], r["mixed"]) == (t * (t + 1) // 2, mixed)
    assert len({r["part"] for r in df.select(F.spark_partition_id().alias("part")).collect()}) > 1
    few = [r for r in rows if r[1] < 60]
    assert told(prefixtrie.op11(spark.createDataFrame(few, SCHEMA).repartition(5))) == plain(few)


def test_digest_of_a_large_group(spark):
    ids = spark.range(50_000).select(F.lit(1).cast("long").alias("k1"), (F.col("id") % 2).alias("k2"), F.col("id").alias("conv_id"))
    want = {k: hashlib.sha256(",".join(map(str, range(k, 50_000, 2))).encode()).hexdigest() for k in (0, 1)}
    assert {r["k2"]: r["ends_sha256"] for r in prefixtrie.end_digests(ids.repartition(6)).collect()} == want


def test_empty_tables(spark):
    assert rows_of(prefixtrie.op11(spark.createDataFrame([], SCHEMA))) == []
    assert rows_of(prefixtrie.op11(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


@settings(max_examples=2, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["user", "assistant"]), st.sampled_from(["a", "b"])), min_size=1, max_size=40))
def test_random_tables(spark, turns):
    rows = [(c, i, role, text) for i, (c, role, text) in enumerate(turns)]
    assert told(prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA), at_once=2)) == plain(rows)
