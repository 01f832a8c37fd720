"""SimHash near-duplicate classes: word-shingle fingerprints, pigeonhole blocks, verified Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.common import counted_cut, cut, texts_for_python, whole
from weftwork.llm.components import connected_components

BITS = 64
SHINGLE = 4
MAX_DISTANCE = 4
#: Blocks the fingerprint is split into, at least. A close pair agrees on at least BLOCKS - MAX_DISTANCE of them, so it
#: shares the bucket of some choice of that many blocks: 15 choices of two blocks, 21 bits. More blocks mean more
#: choices and smaller buckets (8: 70 choices, 32 bits); they follow the number of fingerprints.
BLOCKS = 6
#: Fingerprints of a bucket that are together by chance, at most.
BY_CHANCE = 64
#: Fingerprints of one bucket that a task holds (8 bytes each); larger buckets take the other way, star_links().
BUCKET_LIMIT = 1 << 20
SEED = 42


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED, step: int = 1 << 15) -> int:
    """Signed 64-bit SimHash: a bit is set where over half of the shingles' XXH64 have it; no words give 0.

    Letters A-Z are lowered, words are split at ASCII white space, shingles repeat as they occur, and fewer
    words than a shingle has make one shingle. Shingles are hashed ``step`` at a time, whatever the length.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total = max(1, len(words) - size + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, step):
        part = words[at : at + step + size - 1]
        shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def simhash_udf(size: int = SHINGLE, seed: int = SEED):
    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size, seed) for t in texts], dtype="int64")

    return simhash


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (long) of each row; a null text has no words."""
    return texts_for_python(docs).select(F.col(id_col).alias("doc_id"), simhash_udf(size, seed)(whole(text_col)).alias("fp"))


def block_masks(blocks: int = BLOCKS, distance: int = MAX_DISTANCE) -> list[int]:
    """Masks of all choices of ``blocks - distance`` blocks, as signed longs."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    spans = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [signed(sum(c)) for c in combinations(spans, blocks - distance)]


def blocks_for(fingerprints: int, distance: int = MAX_DISTANCE) -> int:
    """The fewest blocks whose buckets hold no more than BY_CHANCE of so many unrelated fingerprints."""
    blocks = max(BLOCKS, distance + 2)
    while blocks < BITS // 2 and fingerprints > BY_CHANCE << (BITS * (blocks - distance) // blocks):
        blocks += 1
    return blocks


def signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; numpy counts the bits of a negative number's absolute value, so count unsigned."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def bucket_links(fps: np.ndarray, distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of one bucket: at most one for each fingerprint.

    A breadth-first walk compares a reached fingerprint with those that nothing has reached yet, so that a
    group of near copies costs its size and not all its pairs.
    """
    rest, a, b = fps, [], []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            close = differing(x, rest) <= distance
            if close.any():
                found = rest[close]
                a.append(np.full(len(found), x))
                b.append(found)
                frontier.extend(found)
                rest = rest[~close]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def unlinked(choice: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"choice": choice, "a": fp, "b": pd.array([None] * len(fp), dtype="Int64")})


def links_of_sorted(choice: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int) -> pd.DataFrame:
    """Verified links of rows that are sorted by bucket."""
    fresh = np.flatnonzero((np.diff(choice, prepend=-1) != 0) | (np.diff(key, prepend=0) != 0) | (np.arange(len(fp)) == 0))
    sizes = np.diff(np.append(fresh, len(fp)))
    twos = fresh[sizes == 2]
    twos = twos[differing(fp[twos], fp[twos + 1]) <= distance]
    found = [(choice[twos], fp[twos], fp[twos + 1])]
    for start, n in zip(fresh[sizes > 2], sizes[sizes > 2], strict=True):
        a, b = bucket_links(fp[start : start + n], distance)
        found.append((np.full(len(a), choice[start]), a, b))
    c, a, b = map(np.concatenate, zip(*found, strict=True))
    return pd.DataFrame({"choice": c.astype("int32"), "a": a, "b": pd.array(b, dtype="Int64")})


def block_links(distinct: DataFrame, blocks: int = BLOCKS, distance: int = MAX_DISTANCE, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within ``distance``.

    ``distinct(fp)`` is repeated for each choice of blocks, dealt and sorted by bucket, and each task walks its
    buckets, holding one at a time. Buckets over ``limit`` are returned unlinked and go to star_links().
    """
    masks = block_masks(blocks, distance)
    choices = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    dealt = distinct.select("fp", choices.alias("at")).select("at.choice", "at.key", "fp").repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (np.array([], "int32"), np.array([], "int64"), np.array([], "int64"))
        over: tuple[int, int] | None = None  # the bucket that is too large and may go on
        for batch in batches:
            rows = tuple(batch[c].to_numpy() for c in ("choice", "key", "fp"))
            if over is not None:
                more = (rows[0] == over[0]) & (rows[1] == over[1])
                yield unlinked(rows[0][more], rows[2][more])
                rows = tuple(x[~more] for x in rows)
            if not len(rows[0]):
                continue
            rows, over = tuple(map(np.concatenate, zip(held, rows, strict=True))), None
            other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            start = int(other[-1]) + 1 if len(other) else 0  # of the last bucket, which may go on
            yield links_of_sorted(*(x[:start] for x in rows), distance)
            held = tuple(x[start:] for x in rows)
            if len(held[0]) > limit:
                over = (held[0][-1], held[1][-1])
                yield unlinked(held[0], held[2])
                held = tuple(x[:0] for x in held)
        yield links_of_sorted(*held, distance)

    found = cut(dealt.mapInPandas(walk, "choice int, a long, b long"))
    links = found.filter("b is not null").select("a", "b")
    over = found.filter("b is null").select("choice", F.col("a").alias("fp")).distinct()
    return links if over.isEmpty() else links.union(star_links(over, masks, distance))


def star_links(over: DataFrame, masks: list[int], distance: int = MAX_DISTANCE) -> DataFrame:
    """Links of the rows ``(choice, fp)`` of buckets that are too large for a task, without any pairs.

    Two fingerprints are within an even ``distance`` if and only if some point lies within half of it from
    both. Each fingerprint goes to all points near it that agree on its choice of blocks;
    those that meet at a point are linked to the smallest there. A point has at most as many neighbours as
    there are near points, however large the bucket is. The table of masks has a fixed size and is broadcast.
    """
    if distance % 2:
        raise ValueError("buckets over the limit need an even distance")
    half, spark = distance // 2, over.sparkSession
    rows = [(i, signed(sum(1 << b for b in bits))) for i, m in enumerate(masks) for r in range(half + 1) for bits in combinations([b for b in range(BITS) if not m >> b & 1], r)]
    moves = spark.createDataFrame(rows, "choice int, move long")
    near = over.join(F.broadcast(moves), "choice").select("fp", F.col("fp").bitwiseXOR(F.col("move")).alias("point"))
    first = near.groupBy("point").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return near.join(first, "point").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()


def classes_of(fps: DataFrame, blocks: int | None = None, distance: int = MAX_DISTANCE, limit: int = BUCKET_LIMIT) -> DataFrame:
    """``fps(doc_id, fp)`` with component_id; doc_id may be of any orderable type. ``blocks`` follow their number if not given.

    Equal fingerprints are one class from the start, so copies never meet in the link search; then classes
    are linked, and a component takes the smallest id of its classes.
    """
    classes, n = counted_cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), part_rows=None)
    linked = connected_components(block_links(classes.select("fp"), blocks or blocks_for(n, distance), distance, limit))
    members = linked.join(classes, linked["node"] == classes["fp"]).select("fp", "label", "first_id")
    smallest = members.groupBy("label").agg(F.min("first_id").alias("least_id"))
    named = members.join(smallest, "label").select("fp", "least_id")
    component = cut(classes.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")))
    return fps.join(component, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, **search: int) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links reach).

    Texts without words, null ones too, have fingerprint 0 and link like any other; null ids are kept and are
    nobody's smallest id; repeated rows are in one class; an empty table gives an empty result.
    """
    return classes_of(cut(fingerprints(docs, id_col, text_col, size)), **search)


def hex16(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op9(docs: DataFrame) -> DataFrame:
    return near_duplicate_classes(docs).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")
