"""Ranked lexical search against plain sums over all documents."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ROWS, clashing, empty_docs, odd_docs
from weftwork.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def plain(docs: list[tuple], items: list[tuple], k: int = 50) -> list[tuple]:
    """item_id, rank, doc_id, score."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    documents, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    held = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            score = 0
            for t in set(terms(text)) & c.keys():
                m = 100 - 50 + 50 * c.total() * documents // total
                score += math.floor(1000 * math.log((2 * documents + 2) / (2 * held[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def told(df) -> list[tuple]:
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


QUERIES = [(1, "The OLD bridge, built with stone"), (2, "naïve 日本語 café"), (3, None), (4, " --- "), (None, "word7 number number"), (5, "same line"), (5, "same line"), (1, "x y z"), (6, "nothing-here at0all")]


def test_odd_tables(spark):
    docs = [(r[0], r[1]) for r in ROWS] * 2
    df = odd_docs(spark).union(odd_docs(spark))
    items = spark.createDataFrame(QUERIES, ITEMS)
    want = plain(docs, QUERIES)
    assert told(lexical.op13(df, items)) == want
    assert told(lexical.op13(clashing(df), clashing(items.withColumnRenamed("item_id", "i")).withColumnRenamed("i", "item_id"))) == want
    assert told(lexical.ranked_search(df, items, block_bytes=20)) == want  # a pass for each of many blocks
    assert told(lexical.ranked_search(df.repartition(3), items, k=2)) == plain(docs, QUERIES, 2)


def test_empty_tables(spark):
    items = spark.createDataFrame(QUERIES, ITEMS)
    assert lexical.op13(empty_docs(spark), items).collect() == []
    assert lexical.op13(odd_docs(spark), items.limit(0)).collect() == []


def test_other_kinds_of_ids(spark):
    docs = [("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")]
    df = lexical.ranked_search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([(1, "one")], ITEMS))
    assert [r["doc_id"] for r in df.orderBy("rank").collect()] == ["a", "b", None]


def test_terms_table():
    table = lexical.terms_table()
    for b in range(128):
        assert (lexical.terms_of(bytes([b]), table) == [chr(b).translate(LOWER).encode()]) == bool(TERM.match(chr(b)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefg"), min_size=0, max_size=12), min_size=1, max_size=40), st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=6), st.integers(1, 6))
def test_bounds_keep_the_best(docs, asked, k):
    """Whatever the bounds drop is not among the best k; what they keep has its exact score."""
    numbers = {t: i for i, t in enumerate("abcdefgh")}
    counts = [Counter(d) for d in docs]
    n, total = sum(bool(d) for d in docs), sum(map(len, docs))
    sizes = np.array([len(c) for c in counts])
    at = np.array([numbers[t] for c in counts for t in sorted(c)], dtype=np.int64)
    tf = np.array([c[t] for c in counts for t in sorted(c)], dtype=np.int64)
    held = np.bincount(at, minlength=8)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * held + 1))).astype(np.int64)
    shard = lexical.Shard(np.array([len(d) for d in docs], dtype=np.int64), sizes, at, tf, n, max(total, 1))
    wanted = np.array(list(dict.fromkeys(numbers[t] for t in asked)))
    found = dict(zip(*(x.tolist() for x in shard.best(wanted, weights[wanted], k, 1)), strict=True))
    want = [(-s, d) for _, _, d, s in plain([(i, " ".join(d)) for i, d in enumerate(docs)], [(0, " ".join(asked))], k)]
    assert {d: -s for s, d in want}.items() <= found.items()


def test_length_factors_beyond_64_bits():
    n = np.array([10**9, 7], dtype=np.int64)
    assert lexical.length_factors(n, 10**10, 10**13).tolist() == [50 + 50 * x * 10**10 // 10**13 for x in (10**9, 7)]
