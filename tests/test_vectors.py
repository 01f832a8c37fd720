"""The inverted-file index against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from weftwork.operators import vectors


def made(n: int, size: int, seed: int) -> np.ndarray:
    """Half in clusters, half anywhere."""
    rng = np.random.default_rng(seed)
    near = rng.standard_normal((10, size))[rng.integers(0, 10, n)] + 0.3 * rng.standard_normal((n, size))
    return np.where(rng.random((n, 1)) < 0.5, near, rng.standard_normal((n, size))).astype(np.float32)


@pytest.mark.parametrize(("missed", "recall"), [(0.0, 1.0), (vectors.MISSED, 0.9)])
def test_recall(spark, missed, recall):
    x, q = made(3000, 24, 0), made(60, 24, 1)
    rows = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, query_embedding array<double>")
    found = vectors.nearest_to(asked, rows, 10, missed=missed).collect()
    cosine = (q.astype(float) @ x.T.astype(float)) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    want = {(i, f"c{j}") for i in range(60) for j in np.argsort(-cosine[i])[:10]}
    assert len(found) == 600 and len(want & {(r["query_id"], r["chunk_id"]) for r in found}) >= recall * 600
    assert all(abs(r["score"] - cosine[r["query_id"], int(r["chunk_id"][1:])]) < 1e-6 for r in found)


def test_blocks_of_a_large_list(spark, monkeypatch):
    """Most vectors in one list: it is cut into blocks, and copies are found by their place."""
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 4 * 8 * 100)
    x = np.concatenate([np.tile(made(1, 8, 0), (700, 1)), made(300, 8, 2)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(3)
    found = vectors.nearest(rows, "id < 3", 4).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found) == [(q, i + 1, v) for q in range(3) for i, v in enumerate([x for x in range(6) if x != q][:4])]


def test_empty_and_unusable(spark):
    none = spark.createDataFrame([], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_embedding array<float>")
    zero = spark.createDataFrame([("a", [0.0, 0.0]), ("b", None)], "chunk_id string, embedding array<float>")
    other = spark.createDataFrame([("a", [1.0, 0.0, 0.0])], "chunk_id string, embedding array<float>")
    assert [vectors.nearest_to(asked, t, 3).collect() for t in (none, zero, other)] == [[], [], []]


def test_plan_holds_no_product(spark):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made(50, 4, 0))], "id long, vector array<float>")
    plan = vectors.nearest(rows, "id < 5", 3)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
