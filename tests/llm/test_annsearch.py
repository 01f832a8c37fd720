"""Nearest neighbours against brute force: recall, exact scores, ties, copies and odd vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import CLASHES
from weftwork.llm import annsearch
from weftwork.operators import vectors

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows: list[tuple], every: int, k: int) -> list[tuple]:
    """query_id, rank, vec_id, score of usable rows."""
    v = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    n = np.sqrt(np.einsum("ij,ij->i", v, v))
    out = []
    for i, (q, _) in enumerate(rows):
        if q is None or q % every:
            continue
        score = np.einsum("ij,ij->i", np.repeat(v[i : i + 1], len(v), axis=0), v) / (n[i] * n)
        best = sorted((-score[j], r[0] is None, r[0] or 0, j) for j, r in enumerate(rows) if j != i)[:k]
        out += [(q, rank, rows[j][0], -s) for rank, (s, _, _, j) in enumerate(best, 1)]
    return sorted(out, key=repr)


def told(df) -> list[tuple]:
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=repr)


def same(a: list[tuple], b: list[tuple]) -> bool:
    return [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], rtol=0, atol=1e-12)


def random_rows(n: int, size: int, seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    return [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((n, size)).astype(np.float32))]


def test_few_rows_of_every_kind(spark):
    """Ties, copies, null and repeated ids, other lengths of vector; so few rows that all lists are probed."""
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (7, [3.0, 0.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (100, [1.0, 1.0]), (8, [-1.0, 0.5]), (9, [1e-30, 1e-30])]
    unusable = [(150, None), (200, []), (250, [0.0, 0.0]), (300, [1.0, None]), (350, [math.nan, 1.0]), (400, [math.inf, 1.0]), (450, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows + unusable, SCHEMA)
    assert same(told(annsearch.op12(df)), brute(rows, 50, 5))
    clashing = df.select("*", *[F.lit(c).alias(c) for c in (*CLASHES, "id", "vector", "list", "floor", "score")])
    assert same(told(annsearch.op12(clashing)), brute(rows, 50, 5))


def test_fewer_candidates_than_asked_for(spark):
    assert told(annsearch.op12(spark.createDataFrame([(0, [1.0, 2.0])], SCHEMA))) == []
    assert told(annsearch.op12(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], SCHEMA))) == [(0, 1, 1, pytest.approx(1.0))]
    assert annsearch.op12(spark.createDataFrame([], SCHEMA)).collect() == []


def test_doubles_beyond_single_precision(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [3.0, 1.0])]
    got = told(annsearch.op12(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [(r[2], round(r[3], 9)) for r in got] == [(1, round(3 / math.sqrt(10), 9)), (2, round(4 / math.sqrt(20), 9))]


def test_all_lists_without_tests_are_exact(spark):
    rows = random_rows(1500, 24)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    exact = vectors.nearest(df, "id % 50 = 0", 5, missed=0, prepared=lambda size: annsearch.adaptive(size, 8, 50.0), id_col="vec_id", vector_col="embedding")
    got = sorted(((r["query_id"], r["rank"], r["id"], r["score"]) for r in exact.collect()), key=repr)
    assert same(got, brute(rows, 50, 5))


def test_recall_of_random_vectors(spark):
    """Vectors without any structure, the hardest there are."""
    rows = random_rows(4000, 32)
    got = told(annsearch.op12(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    want = brute(rows, 50, 5)
    assert len(got) == len(want)
    found = {(q, v): s for q, _, v, s in got}
    assert sum((q, v) in found for q, _, v, _ in want) >= 0.9 * len(want)
    scores = {(q, v): s for q, _, v, s in brute(rows, 50, len(rows))}
    assert all(abs(scores[x] - s) < 1e-12 for x, s in found.items())


def test_a_vector_that_a_third_of_the_rows_hold(spark):
    rows = random_rows(900, 16)
    copies = [(i, rows[0][1]) for i in range(900, 1400)]
    got = told(annsearch.op12(spark.createDataFrame(rows + copies, SCHEMA).repartition(4)))
    want = brute(rows + copies, 50, 5)
    of = lambda x: [r for r in x if r[0] == 0 or r[0] >= 900]  # noqa: E731  the copies among the queries
    assert same(of(got), of(want))


def test_tests_abandon_early_and_keep_the_near():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    block = vectors.Pack(np.arange(3000), np.arange(3000), np.ones(3000, bool), x, np.full(3000, -np.inf))
    near = vectors.unit(x[:50]) @ vectors.unit(x).T
    floor = np.sort(near, axis=1)[:, -6].astype(float)
    queries = block.take(np.arange(50))._replace(floor=floor)
    q, v, score = annsearch.adaptive(64)(block)(queries, 5)
    want = set(zip(*(i.tolist() for i in np.nonzero(near >= floor[:, None])), strict=True))
    assert len(want & set(zip(q.tolist(), v.tolist(), strict=True))) >= 0.97 * len(want)
    kept = [(vectors.unit(x[:50]) @ annsearch.rotation(64))[:, :w] for w in (16, 32, 48)]
    turned = vectors.unit(x) @ annsearch.rotation(64)
    shares = [((k @ turned[:, : k.shape[1]].T) >= annsearch.least_parts(floor, (k**2).sum(1), 64)[:, None]).mean() for k in kept]
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.15
