"""Near-dedup: links are verified on the texts, groups of candidates of any size."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from tests.llm.test_simhash import components, edited, shingles
from weftwork.llm import neardedup
from weftwork.llm.components import connected_components


def similarity(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def kept(spark, texts: list[str]) -> set[int]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in neardedup.drop_near_duplicates(docs).collect()}


def same_classes(got: list[int], want: list[int]) -> bool:
    return len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def drawn(rng: random.Random, n: int) -> str:
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_pairs_below_the_similarity_stay(spark):
    rng = random.Random(8)
    texts = []
    while len(texts) < 240:
        text = drawn(rng, rng.randrange(100, 400))
        copy = edited(text, rng.uniform(0.12, 0.3), rng)
        if 0.5 <= similarity(text, copy) <= 0.78:
            texts += [text, copy]
    assert kept(spark, texts) == set(range(len(texts)))


def similar_pairs(rng: random.Random, n: int, wanted: float) -> list[str]:
    """Texts 2k and 2k + 1 have a similarity just above ``wanted``: words far apart are changed, five shingles for each."""
    texts: list[str] = []
    for _ in range(n):
        found = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 400))]
        copy, shingles = list(found), len(found) - 4
        for i in range(int(shingles * (1 - wanted) / (5 * (1 + wanted)))):
            copy[5 + 9 * i] = f"x{rng.randrange(10**6)}"
        texts += [" ".join(found), " ".join(copy)]
    return texts


@pytest.mark.parametrize("bits", [15, 22])
def test_recall_just_above_the_similarity(spark, monkeypatch, bits):
    """Of pairs at 0.8 to 0.86, most of them near 0.8, nearly all are found, with the blocks of small tables and with those of large ones."""
    monkeypatch.setattr(neardedup, "LEAST_BITS", bits)
    texts = similar_pairs(random.Random(bits), 300, 0.8)
    assert all(0.8 <= similarity(a, b) <= 0.86 for a, b in zip(texts[::2], texts[1::2], strict=True))
    recall = (len(texts) - len(kept(spark, texts))) / 300
    print("recall", bits, recall)
    assert recall >= 0.97


def test_blocks_follow_the_number_of_texts():
    assert neardedup.block_plan(0) == neardedup.block_plan(200_000) == (15, 5)
    for n in (10**7, 10**9, 10**11):
        bits, orders = neardedup.block_plan(n)
        places = neardedup.block_orders(bits, orders)
        assert n / 2**bits <= neardedup.BY_CHANCE and places.shape == (orders * (256 // bits), bits)
        assert all(len(set(block)) == bits for block in places.tolist())
        assert (1 - (1 - 39 / 256) ** bits) ** len(places) <= neardedup.MISSED
    keys = neardedup.block_keys(bytes(range(32)), neardedup.block_orders(15, 5))
    assert len(keys) == len(set(keys)) == 85 and [k >> 15 for k in keys] == list(range(85))


def test_a_repeated_line_makes_no_near_copies(spark):
    rng = random.Random(9)
    line = drawn(rng, 12)
    texts = []
    for _ in range(30):
        found = drawn(rng, 700).split()
        for _ in range(25):
            found.insert(rng.randrange(len(found)), line)
        texts.append(" ".join(found))
    assert max(similarity(a, b) for a, b in combinations(texts, 2)) < 0.3
    assert kept(spark, texts) == set(range(len(texts)))


def test_texts_of_one_group_are_verified(spark):
    rng = random.Random(10)
    texts = [drawn(rng, 100) for _ in range(6)]
    texts += [edited(t, 0.05, rng) for t in texts[:3]]
    rows = [(i, 0, neardedup.shingle_set(t).tobytes()) for i, t in enumerate(texts)]
    links = neardedup.verified_links(spark.createDataFrame(rows, "node long, label long, shingles binary")).collect()
    assert sorted((r["a"], r["b"]) for r in links) == [(0, 6), (1, 7), (2, 8)]


def made_sets(seed: int, n: int) -> list[np.ndarray]:
    """Sets of which each is made from an earlier one by changes around the limit, and some empty ones."""
    rng, out = random.Random(seed), [np.array([], dtype="<u8")]
    while len(out) < n:
        old = sorted(rng.choice(out[-12:]).tolist()) if rng.random() < 0.9 else []
        new = rng.sample(old, int(len(old) * rng.uniform(0.85, 1))) if old else []
        size = rng.randrange(20, 60) if not old else int(len(old) * rng.uniform(0, 0.14))
        out.append(np.unique(np.array([*new, *(rng.getrandbits(64) for _ in range(size))], dtype="<u8")))
    return out


def brute(sets: list[np.ndarray]) -> list[int]:
    found = [set(x.tolist()) for x in sets]
    return components(len(sets), [(i, j) for (i, a), (j, b) in combinations(enumerate(found), 2) if a and b and 5 * len(a & b) >= 4 * len(a | b)])


def test_a_group_is_joined_by_verified_links():
    for seed in range(30):
        sets = made_sets(seed, 60)
        a, b = neardedup.verified_forest(np.arange(len(sets)), sets)
        want = brute(sets)
        assert len(a) == len(sets) - len(set(want)) and 1 < len(set(want)) < len(sets)
        assert same_classes(components(len(sets), zip(a.tolist(), b.tolist(), strict=True)), want)


@pytest.mark.parametrize("part", [1 << 20, 1000, 150])
def test_large_groups_are_verified_in_parts(spark, part):
    groups = [made_sets(s, n) for s, n in ((1, 200), (2, 150), (3, 4), (4, 1))]
    sets = [x for g in groups for x in g]
    label = [i for i, g in enumerate(groups) for _ in g]
    rows = [(n, i, x.tobytes()) for n, (i, x) in enumerate(zip(label, sets, strict=True))]
    links = neardedup.verified_links(spark.createDataFrame(rows, "node long, label long, shingles binary"), part)
    got = {r["node"]: r["label"] for r in connected_components(links).collect()}
    want, start = [], 0
    for g in groups:
        want += [start + r for r in brute(g)]
        start += len(g)
    assert same_classes([got.get(i, i) for i in range(len(sets))], want)


def test_a_bucket_over_the_limit_loses_no_link(spark):
    """A chain of edits: each fingerprint is close to the one before it and to no other."""
    rng = random.Random(4)
    fps = [rng.getrandbits(256)]
    for _ in range(99):
        fps.append(fps[-1] ^ sum(1 << b for b in rng.sample(range(256), 40)))
    rows = [(i, f.to_bytes(32, "little"), [7]) for i, f in enumerate(fps)] + [(1000 + i, f.to_bytes(32, "little"), [8]) for i, f in enumerate(fps[:3])]
    keyed = spark.createDataFrame(rows, "row long, fp binary, keys array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        labels = {r["node"]: r["label"] for r in connected_components(neardedup.similar_links(keyed, limit=15)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert labels == {**{i: 0 for i in range(100)}, **{1000 + i: 1000 for i in range(3)}}
