"""The corpus pipeline: every stage on its own input, then the whole."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.helpers import clashing, empty_docs, odd_docs
from tests.llm.test_simhash import components, shingles
from weftwork.llm import mixing, packing, quality
from weftwork.llm.common import documents, shared_path


def run_stages(spark, docs):
    """The frames after each stage, each written and read again."""
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, f"test-{name}")
        stage(spark, out[-1], SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def near_classes(texts: list[str]) -> list[int]:
    """For each text the number of its component, by comparing the five-word shingle sets of all pairs."""
    sets = [shingles(x) for x in texts]
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] == sets[j] or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
    return components(len(texts), links)


def check_stages(frames) -> None:
    """Each stage's rows against plain Python on the rows before it, by text: ids may be null and repeat."""
    raw, good, distinct, apart, mixed, packed = frames
    assert all(x.columns == raw.columns for x in (good, distinct, apart, mixed))
    texts = lambda df: [r["text"] or "" for r in df.collect()]
    kept = Counter(r["doc_id"] for r in quality.op1(raw).filter("kept").collect())
    assert Counter(r["doc_id"] for r in good.collect()) == kept
    largest = {}
    for r in good.collect():
        largest[r["text"] or ""] = max(largest.get(r["text"] or "", -(1 << 40)), -(1 << 40) if r["doc_id"] is None else r["doc_id"])
    assert sorted((r["text"] or "", -(1 << 40) if r["doc_id"] is None else r["doc_id"]) for r in distinct.collect()) == sorted(largest.items())
    rows = sorted(distinct.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    first = {}
    for r, label in zip(rows, near_classes([r["text"] or "" for r in rows]), strict=True):
        first.setdefault(label, r["text"] or "")
    assert sorted(texts(apart)) == sorted(first.values())
    planned = Counter()
    for r in mixing.mixing_plan(apart).collect():
        planned[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +planned
    assert packed.count() == packing.token_pieces(mixed).count()


def test_stages(spark):
    frames = run_stages(spark, documents(spark, SMALL))
    check_stages(frames)
    assert all(b.count() < a.count() for a, b in zip(frames[:3], frames[1:4], strict=True))


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    *_, packed = run_stages(spark, documents(spark, SMALL))
    piece = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(piece, rows)) == Counter(map(piece, packed.collect()))


@pytest.mark.parametrize("make", [odd_docs, empty_docs, lambda spark: clashing(odd_docs(spark))])
def test_odd_tables(spark, make):
    docs = make(spark)
    check_stages(run_stages(spark, docs))
