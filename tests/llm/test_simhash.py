"""SimHash classes against all pairs, the large-bucket way against the usual one, near-dedup against exact similarity."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from tests.llm.helpers import LONG, PROSE, clashing, empty_docs, odd_docs, words
from weftwork.llm import neardedup, simhash
from weftwork.llm.common import documents
from weftwork.llm.components import connected_components


def brute_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = words(lowered)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def brute_classes(rows: list[tuple[int | None, int]], distance: int = 4) -> list[tuple]:
    """(doc_id, fp, smallest doc_id of its component) of rows (doc_id, unsigned fp)."""
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if (rows[i][1] ^ rows[j][1]).bit_count() <= distance]
    roots = components(len(rows), links)
    least: dict[int, int | None] = {}
    for (doc_id, _), r in zip(rows, roots, strict=True):
        known = [x for x in (least.get(r), doc_id) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((i, f"{fp:016x}", least[r]) for (i, fp), r in zip(rows, roots, strict=True)), key=repr)


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_documents(spark):
    for docs in (documents(spark, SMALL), odd_docs(spark)):
        rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
        assert told(simhash.op9(docs)) == brute_classes(rows)


def test_long_texts_are_hashed_in_steps():
    assert simhash.fingerprint(LONG, step=1000) % (1 << 64) == brute_fingerprint(LONG) == simhash.fingerprint(LONG) % (1 << 64)


def near_fingerprints(seed: int, n: int) -> list[int]:
    """Chains and clouds of fingerprints around the limit of four bits."""
    rng, out = random.Random(seed), [0, 1 << 63, (1 << 64) - 1]
    while len(out) < n:
        fp = rng.choice(out) if rng.random() < 0.8 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.choice([1, 3, 4, 4, 5, 6])):
            fp ^= 1 << b
        out.append(fp)
    return out


def test_links_at_four_bits(spark):
    rows = list(enumerate(near_fingerprints(1, 600)))
    fps = spark.createDataFrame([(i, simhash.signed(f)) for i, f in rows], "doc_id long, fp long")
    expected = brute_classes(rows)
    for search in ({}, {"blocks": 8}, {"limit": 3}, {"limit": 0}):  # the last two: buckets too large for a task
        classes = simhash.classes_of(fps, **search)
        assert told(classes.select("doc_id", simhash.hex16("fp"), "component_id")) == expected


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40))
def test_a_bucket_is_joined_by_few_links(seed, n):
    fps = np.array([simhash.signed(f) for f in set(near_fingerprints(seed, n))], dtype="int64")
    a, b = simhash.bucket_links(fps)
    assert len(a) < len(fps)
    place = {int(f): i for i, f in enumerate(fps)}
    got = components(len(fps), [(place[int(x)], place[int(y)]) for x, y in zip(a, b, strict=True)])
    pairs = [(i, j) for i, j in combinations(range(len(fps)), 2) if (int(fps[i]) ^ int(fps[j])) % (1 << 64) and ((int(fps[i]) ^ int(fps[j])) % (1 << 64)).bit_count() <= 4]
    want = components(len(fps), pairs)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


@pytest.mark.parametrize("at_once", [0, 40, 1 << 16])
def test_components(spark, at_once):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200)]
    labels = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(chain, "a long, b long"), at_once).collect()}
    assert labels == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([(5, 5)], "a long, b long")).collect() == []


@pytest.mark.parametrize("at_once", [0, 100, 1 << 16])
def test_components_of_any_graph(spark, at_once):
    rng = random.Random(11)
    for n, links in ((400, 250), (400, 700), (60, 59)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(links)] + [(n - 1, i) for i in range(0, 30, 2)]
        roots = components(n, edges)
        least: dict[int, int] = {}
        for i, r in enumerate(roots):
            least.setdefault(r, i)
        linked = {x for a, b in edges if a != b for x in (a, b)}
        labels = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), at_once).collect()}
        assert labels == {i: least[roots[i]] for i in linked}


def test_blocks_follow_the_number_of_fingerprints():
    assert simhash.blocks_for(0) == simhash.blocks_for(10**8) == 6
    for n in (10**9, 10**10, 10**12):
        blocks = simhash.blocks_for(n)
        assert n / 2 ** (64 * (blocks - 4) // blocks) <= simhash.BY_CHANCE < n / 2 ** (64 * (blocks - 5) // (blocks - 1))


def test_odd_tables(spark):
    assert simhash.op9(empty_docs(spark)).collect() == []
    one = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, None)], "doc_id long, text string")
    assert told(simhash.op9(one))[0][0] == 3
    assert simhash.op9(clashing(odd_docs(spark))).count() == odd_docs(spark).count()


def shingles(text: str, n: int = 5) -> set[tuple]:
    found = words(text.lower())
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))}


def edited(text: str, share: float, rng: random.Random) -> str:
    """A run of words replaced, so that about ``share`` of the shingles go."""
    found = text.split()
    n = max(1, int(share * len(found)))
    at = rng.randrange(0, len(found) - n)
    return " ".join([*found[:at], *(f"new{rng.random()}" for _ in range(n)), *found[at + n :]])


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    bases = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(80, 400))) for _ in range(120)]
    rows, near = [(i, t) for i, t in enumerate(bases)], {}
    for i, t in enumerate(bases[:80]):
        copy = edited(t, 0.08, rng)
        a, b = shingles(t), shingles(copy)
        if len(a & b) / len(a | b) >= 0.8:
            near[1000 + i] = i
        rows.append((1000 + i, copy))
    rows += [(2000 + i, edited(t, 0.6, rng)) for i, t in enumerate(bases[80:])]  # similarity of 0.25 or less
    kept = {r["doc_id"] for r in neardedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(120)) <= kept and {i for i, _ in rows if i >= 2000} <= kept
    gone = [i for i in near if i not in kept]
    assert len(near) > 60 and len(gone) >= 0.95 * len(near)


def test_near_copies_of_documents(spark):
    """All pairs of the documents, exactly: of similar ones a group keeps one, documents like no other stay."""
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SMALL).select("doc_id", "text").collect()]
    sets = [shingles(t or "") for _, t in rows]
    pairs = [(i, j, len(a & b) / len(a | b)) for (i, a), (j, b) in combinations(enumerate(sets), 2) if len(words(rows[i][1])) >= 5 and len(words(rows[j][1])) >= 5 and a & b]
    kept = {r["doc_id"] for r in neardedup.drop_near_duplicates(documents(spark, SMALL)).collect()}
    similar = [(i, j) for i, j, s in pairs if s >= 0.8]
    both = [(i, j) for i, j in similar if rows[i][0] in kept and rows[j][0] in kept]
    assert similar and len(both) <= 0.05 * len(similar)
    linked = {k for i, j, s in pairs if s >= 0.5 for k in (i, j)}
    alone = [rows[i][0] for i in range(len(rows)) if i not in linked and len(words(rows[i][1])) >= 30]
    assert alone and set(alone) <= kept


def test_large_buckets_are_walked_in_parts(spark):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(200))
    rows = [(i, text + f" {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = [neardedup.wide_fingerprint(t) for _, t in rows]
    keyed = spark.createDataFrame([(i, f, neardedup.block_keys(f, neardedup.block_orders(15, 4))) for i, f in enumerate(hashed)], "row long, fp binary, keys array<long>")
    labels = connected_components(neardedup.similar_links(keyed, limit=20)).select("label").distinct().count()
    assert labels == 1
    assert [r["doc_id"] for r in neardedup.drop_near_duplicates(docs).collect()] == [0]


def test_near_dedup_of_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    kept = neardedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert sum(not words(t) for t in texts) == 1 and texts.count(LONG) == 1
    assert sum((t or "").lower() == PROSE.lower() for t in texts) == 1  # case alone makes no other text
    assert neardedup.drop_near_duplicates(empty_docs(spark)).collect() == []
