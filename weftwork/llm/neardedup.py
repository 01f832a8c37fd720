"""Near-dedup of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Fingerprints only pick candidates: each distinct shingle counts once in a fingerprint of 256 bits, which is cut into
blocks in several orders of its bits; texts that share a block meet, and those within a distance become one group of
candidates. Blocks get wider, and more of them, with the number of texts, so that a block's buckets hold about as many
unrelated texts at every size. By calculation a pair at 0.8 shares a block with a probability of 0.999 and is within
the distance with one over 0.999. Every link is then verified on the shingle sets of its two texts: within a group of
candidates all pairs are, as far as they may still join what no other link has joined. The tests measure recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import counted_cut, cut, if_small, located, texts_for_python, whole
from weftwork.llm.components import connected_components

LANES, SHINGLE, SEED = 4, 5, 42
BITS = 64 * LANES
#: Differing bits of 256: texts with a Jaccard similarity of 0.8 differ in 39 on average (deviation 6), of 0.6 in
#: 59 (deviation 7), unrelated ones in 115 or more. Candidates only, so wide of what is looked for.
MAX_DISTANCE = 60
#: The Jaccard similarity of a link, as a fraction.
SIMILARITY = (4, 5)
#: Shingles of one part of a group of candidates, about; a task holds two parts at most (8 bytes a shingle).
PART_SHINGLES = 1 << 20
#: Members of a group of several parts that every part holds, about.
PIVOTS = 16
#: Fingerprints of one bucket that a task holds, 32 bytes each; a larger bucket is one group of candidates.
BUCKET_LIMIT = 1 << 18
#: Bits of a block at least, and the texts of a bucket that are together by chance, at most.
LEAST_BITS, BY_CHANCE = 15, 256
#: Bits in which a pair at 0.8 differs, and the share of such pairs that may share no block.
DIFFERING, MISSED = 39, 0.001


def block_plan(texts: int) -> tuple[int, int]:
    """Bits of a block and number of orders for so many different texts."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, texts) / BY_CHANCE)))
    blocks = math.log(MISSED) / math.log(1 - (1 - DIFFERING / BITS) ** bits)
    return bits, math.ceil(blocks / (BITS // bits))


def block_orders(bits: int, orders: int) -> np.ndarray:
    """Places of the bits of all blocks, a row for each: as they are, across, and then by hashes of their numbers."""
    n = BITS // bits
    by_hash = lambda seed: sorted(range(BITS), key=lambda i: xxhash.xxh64_intdigest(str(i), seed))[: n * bits]
    across = [j * n + i for i in range(n) for j in range(bits)]
    return np.array([[*range(n * bits)], across, *map(by_hash, range(1, orders - 1))][:orders]).reshape(-1, bits)


def lanes(hashes: np.ndarray) -> np.ndarray:
    """Independent 64-bit hashes of each 64-bit hash, one a lane, by multiply and shift."""
    out = np.empty((len(hashes), LANES), dtype="<u8")
    for k in range(LANES):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def shingle_set(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the distinct word shingles, in order; fewer words than a shingle has make one, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], dtype="<u8")
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8"))


def fingerprint_of(shingles: np.ndarray, step: int = 1 << 14) -> bytes:
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(shingles), step):
        ones += np.unpackbits(lanes(shingles[at : at + step]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(shingles), bitorder="little").tobytes()


def wide_fingerprint(text: str, size: int = SHINGLE, seed: int = SEED, step: int = 1 << 14) -> bytes:
    """256-bit SimHash of the distinct word shingles: 32 bytes; texts without words give zeros."""
    return fingerprint_of(shingle_set(text, size, seed), step)


def block_keys(fp: bytes, orders: np.ndarray) -> list[int]:
    """Keys of all blocks: the block's number and its bits."""
    bits = np.unpackbits(np.frombuffer(fp, dtype=np.uint8), bitorder="little")[orders]
    return (np.arange(len(orders)) << orders.shape[1] | bits.astype(np.int64) @ (1 << np.arange(orders.shape[1]))).tolist()


def bucket_forest(ids: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join a bucket's components, fewer than it has members; ``fps`` has LANES words a row.

    A breadth-first walk compares what it reaches with what nothing has reached yet.
    """
    rest, a, b = np.arange(len(ids)), [], []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            close = np.bitwise_count(fps[rest] ^ fps[x]).sum(axis=1, dtype=np.int64) <= distance
            if close.any():
                found = rest[close]
                a.append(np.full(len(found), ids[x]))
                b.append(ids[found])
                frontier.extend(found)
                rest = rest[~close]
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def links_of_sorted(key: np.ndarray, ids: np.ndarray, fps: np.ndarray, distance: int) -> pd.DataFrame:
    fresh = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.arange(len(key)) == 0))
    sizes = np.diff(np.append(fresh, len(key)))
    found = [(ids[:0], ids[:0])]
    # small buckets all at once: neighbours at each lag that are in the same bucket
    small = np.repeat(sizes <= 16, sizes)
    for lag in range(1, 16):
        same = np.flatnonzero(small[lag:] & (key[lag:] == key[:-lag]))
        if not len(same):
            break
        close = same[np.bitwise_count(fps[same] ^ fps[same + lag]).sum(axis=1, dtype=np.int64) <= distance]
        found.append((ids[close], ids[close + lag]))
    for start, n in zip(fresh[sizes > 16], sizes[sizes > 16], strict=True):
        found.append(bucket_forest(ids[start : start + n], fps[start : start + n], distance))
    a, b = map(np.concatenate, zip(*found, strict=True))
    return pd.DataFrame({"a": a, "b": b})


def similar_links(rows: DataFrame, distance: int = MAX_DISTANCE, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) of candidates ``rows(row, fp, keys)``, by the distance within each block's buckets.

    Buckets are dealt and sorted by key and walked one at a time, from the smallest row, so that different buckets
    find the same links where they can. All members of a bucket that has more than ``limit`` are linked to
    its first, whatever their distance: candidates are verified later, so that a task holds no more than
    ``limit`` and a batch, and no pair is lost.
    """
    dealt = rows.select("row", "fp", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key", "row")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (np.array([], "int64"), np.array([], "int64"), np.empty((0, LANES), "<u8"))
        over: tuple[int, int] | None = None  # the key and first row of a bucket that is too large and may go on
        for batch in batches:
            if not len(batch):
                continue
            if over is not None:
                more = batch["key"] == over[0]
                yield pd.DataFrame({"a": over[1], "b": batch["row"][more]})
                batch = batch[~more]
                if not len(batch):
                    continue
                over = None
            now = (batch["key"].to_numpy("int64"), batch["row"].to_numpy("int64"), np.frombuffer(b"".join(batch["fp"]), dtype="<u8").reshape(-1, LANES))
            key, ids, fps = map(np.concatenate, zip(held, now, strict=True))
            other = np.flatnonzero(key != key[-1])
            start = int(other[-1]) + 1 if len(other) else 0
            yield links_of_sorted(key[:start], ids[:start], fps[:start], distance)
            held = (key[start:], ids[start:], fps[start:])
            if len(held[0]) > limit:
                over = (held[0][0], held[1][0])
                yield pd.DataFrame({"a": over[1], "b": held[1][1:]})
                held = tuple(x[:0] for x in held)
        yield links_of_sorted(*held, distance)

    return dealt.mapInPandas(walk, "a long, b long")


def verified_forest(ids: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of all pairs whose sets are similar, fewer than there are sets.

    A breadth-first walk compares the set that it has reached with all that nothing has reached yet; an empty
    set is like no other.
    """
    some = np.array([len(x) > 0 for x in sets], dtype=bool)
    ids, sets, (p, q), a, b = ids[some], [x for x in sets if len(x)], similarity, [], []
    if len(ids) < 2:
        return ids[:0], ids[:0]
    sizes = np.array([len(x) for x in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    held, marks = np.split(flat, np.cumsum(sizes)[:-1]), np.zeros(len(names), dtype=np.uint8)
    rest = np.arange(len(ids))
    while len(rest):
        frontier, rest, flat = [rest[0]], rest[1:], flat[sizes[rest[0]] :]
        while frontier and len(rest):
            x = frontier.pop()
            marks[held[x]] = 1
            both = np.add.reduceat(marks[flat], np.cumsum(sizes[rest]) - sizes[rest], dtype=np.int64)
            marks[held[x]] = 0
            close = both * q >= (sizes[rest] + sizes[x] - both) * p
            if close.any():
                found = rest[close]
                a.append(np.full(len(found), ids[x]))
                b.append(ids[found])
                frontier.extend(found)
                flat, rest = flat[np.repeat(~close, sizes[rest])], rest[~close]
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def links_of_groups(dealt: DataFrame) -> DataFrame:
    """Verified links (a, b) of rows (label, i, j, node, shingles), each group (label, i, j) in one task."""

    def forest(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held).drop_duplicates("node")
        a, b = verified_forest(rows["node"].to_numpy("int64"), [np.frombuffer(x, dtype="<u8") for x in rows["shingles"]])
        return pd.DataFrame({"a": a, "b": b})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None
        for batch in batches:
            if not len(batch):
                continue
            names = batch[["label", "i", "j"]].to_numpy("int64")
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for start, end in zip(edges, edges[1:], strict=False):
                group = tuple(names[start])
                if held and group != at:
                    yield forest(held)
                    held = []
                at = group
                held.append(batch.iloc[start:end])
        if held:
            yield forest(held)

    return dealt.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node").select("label", "i", "j", "node", "shingles").mapInPandas(walk, "a long, b long")


def verified_links(members: DataFrame, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """Links that join what all similar pairs within a group join; ``members(node, label, shingles)`` is cut.

    A group that is too large for a task is dealt into parts by a hash. Each part is walked together with a few members
    that all parts hold; then what the group's largest component has not taken is compared with the whole group,
    part by part as separate tasks: pairs within that component need no link, and all others meet.
    """
    size = F.length("shingles") / 8
    groups = members.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / part_shingles)).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    large, n_large = counted_cut(groups.filter("parts > 1"))
    spread = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    placed = members.join(if_small(large, rows=n_large), "label", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", spread(1, F.col("parts")))
    pivot = (F.col("parts") > 1) & (spread(2, F.greatest(F.lit(1), F.floor(F.col("n") / PIVOTS))) == 0)
    parts = F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    found = links_of_groups(placed.select("label", F.explode(parts).alias("i"), F.lit(0).alias("j"), "node", "shingles"))
    if not n_large:
        return found
    found, _ = counted_cut(found)
    # of the groups in parts: the component that each member is in, the group's largest, and what is not in it
    joined = connected_components(found).withColumnRenamed("label", "joined")
    at, _ = counted_cut(placed.filter("parts > 1").select("node", "label", "part", "parts", size.alias("size")).join(joined, "node", "left").withColumn("joined", F.coalesce("joined", "node")))
    main = at.groupBy("label", "joined").count().groupBy("label").agg(F.max_by("joined", F.struct("count", "joined")).alias("main"))
    left, n_left = counted_cut(at.join(main, "label").filter("joined <> main").select("node", "label", "part", "parts", "size"))
    if not n_left:
        return found
    against, _ = counted_cut(left.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / part_shingles)).cast("int").alias("lefts")))
    whole_group = at.select("node", "label", "part").join(against, "label").select("node", "label", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), F.col("part").alias("j"))
    others = left.join(against, "label").select("node", "label", spread(3, F.col("lefts")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    return found.union(links_of_groups(whole_group.union(others).join(members.select("node", "shingles"), "node")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each group of near duplicates stays, that of the smallest id; same columns, of any names.

    Near duplicates are texts that verified links join, each between two texts whose sets of five-word shingles have
    a Jaccard similarity of 0.8 or more. Null and empty texts are equal to each other and so one of them stays; null
    ids come before all others; of rows that share an id one is told from another by its locator; texts of fewer
    than five words are one shingle; an empty table gives no rows. Fingerprints are kept once; texts with the same
    shingles are one class before the search; the shingles of candidates alone are moved; only the dropped rows'
    locators are joined away.
    """

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        sets = map(shingle_set, texts)
        return pd.Series([fingerprint_of(s) + xxhash.xxh3_128_digest(s.tobytes()) for s in sets])

    @F.pandas_udf("binary")
    def shingled(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).tobytes() for t in texts])

    # as nondeterministic functions they are computed once a row, not again by what stands above
    rows = texts_for_python(located(docs))
    place, text = ["file", "row"], whole(F.col("record")[text_col])
    prints = cut(rows.select(F.col("record")[id_col].alias("doc_id"), *place, hashed.asNondeterministic()(text).alias("print")))
    classes = prints.groupBy("print").agg(F.min(F.struct("doc_id", *place)).alias("first")).withColumn("node", F.monotonically_increasing_id())
    classes, n = counted_cut(classes, part_rows=None)
    orders = block_orders(*block_plan(n))

    @F.pandas_udf("array<long>")
    def keys(fps: pd.Series) -> pd.Series:
        return pd.Series([block_keys(f, orders) for f in fps])

    fps = classes.select(F.col("node").alias("row"), F.expr(f"substring(print, 1, {BITS // 8})").alias("fp"))
    candidates = connected_components(similar_links(fps.select("row", "fp", keys.asNondeterministic()("fp").alias("keys")), distance))
    known, n_known = counted_cut(candidates.join(classes, "node").select("node", "label", "first.file", "first.row"))
    sets = cut(rows.join(if_small(known, rows=n_known), place).select("node", "label", shingled.asNondeterministic()(text).alias("shingles")))
    linked, _ = counted_cut(connected_components(verified_links(sets)).join(classes, "node").select("label", "first"))
    best = linked.groupBy("label").agg(F.min("first").alias("best"))
    stays = linked.join(best, "label").filter("first <> best").select("first.file", "first.row")
    copies = prints.join(classes, "print").filter(F.struct(*place) != F.struct("first.file", "first.row")).select(*place)
    dropped, n_dropped = counted_cut(copies.union(stays))
    return rows.join(if_small(dropped, rows=n_dropped), place, "left_anti").select("record.*")
