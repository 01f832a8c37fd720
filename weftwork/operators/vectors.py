"""Nearest vectors by an inverted-file index: lists around centroids, and queries that look into the lists they need.

Centroids are fitted on a bounded sample of the vectors; every vector is in one list. A query first looks into the few lists
nearest to it, which gives the score that a further vector has to reach; then into as many more as it takes until the
vectors above that score which the rest should hold, by the spread of each list, are few. Lists are cut into blocks;
blocks and the packs of queries that want them meet by (list, block), sorted, so that a task holds one block and one pack.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.storage import materialized

#: Lists are about as many as the square root of the vectors, and at most this many.
MAX_LISTS = 4096
#: Vectors of the sample that centroids are fitted on: so many a list, and no more than these bytes of single precision.
SAMPLE_PER_LIST = 64
SAMPLE_BYTES = 64 << 20
ROUNDS = 8
SEED = 42
#: Bytes of one block's vectors, in single precision, about.
BLOCK_BYTES = 4 << 20
#: Vectors that meet all queries at a time, by brute force.
BLOCK_ROWS = 4096
#: Vectors, or queries, that travel in one row, at most.
PACK_ROWS = 512
#: Lists that every query looks into.
FIRST_LISTS = 8
#: Of the k nearest, so many (a share of k) may be missed in the lists that a query does not look into, as expected.
MISSED = 0.1
#: Single precision tells scores apart by this much.
ROUNDING = 1e-5


class Pack(NamedTuple):
    """Vectors as arrays: row and id (-1 and known false where it is null), the vectors as they are, and a score each."""

    row: np.ndarray
    id: np.ndarray
    known: np.ndarray
    vector: np.ndarray
    floor: np.ndarray

    def take(self, at: np.ndarray) -> Pack:
        return Pack(*[x[at] for x in self])


class Lists(NamedTuple):
    """The index's own numbers, by list: centroid, vectors, their mean cosine with it, blocks."""

    centroids: np.ndarray
    sizes: np.ndarray
    near: np.ndarray
    blocks: np.ndarray


#: Number of the query, number of the vector, exact score.
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]
#: A block's vectors -> what compares them with packs of queries, (queries, k) -> pairs.
Scan = Callable[[Pack], Callable[[Pack, int], Pairs]]

PACKED = "list int, block int, side int, row binary, id binary, known binary, vector binary, floor binary"
FOUND = "query_row long, query_id long, row long, id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """row, id, vector of the rows that take part, and how many components these have.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor those whose number of
    components is not the commonest (of equally common ones the larger). Rows are numbered and cut.
    """
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{'float' if kind == 'float' else 'double'}>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = materialized(rows.filter(finite).select(F.monotonically_increasing_id().alias("row"), "id", "vector"))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    return rows.filter(F.size("vector") == size), size


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(-1, size)


def doubles(v: np.ndarray) -> np.ndarray:
    """Vectors in double precision; those whose squares would leave its range are scaled."""
    v = v.astype(np.float64)
    most = np.abs(v).max(axis=1, initial=0.0)
    odd = (most > 1e120) | (most < 1e-120)
    v[odd] /= most[odd, None]
    return v


def unit(v: np.ndarray) -> np.ndarray:
    """Directions of vectors, in single precision."""
    v = doubles(v)
    return (v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Cosines of the pairs (a[i], b[j]) in double precision, each computed in the same way wherever it stands."""
    a, b = doubles(a), doubles(b)
    na, nb = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    dots = [np.einsum("ij,ij->i", a[i[s : s + step]], b[j[s : s + step]]) for s in range(0, len(i), step)]
    return np.concatenate([*dots, np.empty(0)]) / (na[i] * nb[j])


def nearest_list(v: np.ndarray, centroids: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The centroid with the largest cosine to each unit vector, and that cosine."""
    at, near = [np.empty(0, np.int64)], [np.empty(0, np.float32)]
    for s in range(0, len(v), step):
        c = v[s : s + step] @ centroids.T
        at.append(c.argmax(axis=1))
        near.append(c.max(axis=1))
    return np.concatenate(at), np.concatenate(near)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Spherical k-means of unit vectors: a centroid is the direction of its members' mean; one without members stays."""
    centroids = sample[np.sort(np.random.default_rng(seed).choice(len(sample), lists, replace=False))].copy()
    for _ in range(rounds):
        at, _ = nearest_list(sample, centroids)
        order = np.argsort(at, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
        sums = np.add.reduceat(sample[order], start, axis=0)
        norms = np.linalg.norm(sums, axis=1)
        held = norms > 0
        centroids[at[order][start][held]] = sums[held] / norms[held, None]
    return centroids


def packs(batch: pa.RecordBatch, size: int, floor: np.ndarray | None = None) -> Pack:
    ids = batch.column("id")
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return Pack(batch.column("row").to_numpy(), ids.fill_null(-1).to_numpy(), known, matrix(batch.column("vector"), size), np.full(batch.num_rows, -np.inf) if floor is None else floor)


def packed(rows: list[tuple[int, int, int, Pack]]) -> pa.RecordBatch:
    """(list, block, side, vectors) as rows of PACKED."""
    columns = [pa.array([r[i] for r in rows], pa.int32()) for i in range(3)]
    columns += [pa.array([np.ascontiguousarray(r[3][i]).tobytes() for r in rows], pa.binary()) for i in range(5)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PACKED.split(", ")])


def unpacked(batch: pa.RecordBatch, i: int, size: int, single: bool) -> Pack:
    kinds = [np.int64, np.int64, bool, np.float32 if single else np.float64, np.float64]
    row, own_id, known, vector, floor = (np.frombuffer(batch.column(j + 3)[i].as_buffer(), k) for j, k in enumerate(kinds))
    return Pack(row, own_id, known, vector.reshape(-1, size), floor)


class Index(NamedTuple):
    """The lists and the rows in them, packed by (list, part)."""

    lists: Lists
    rows: DataFrame
    size: int
    single: bool


def build_index(rows: DataFrame, size: int, n: int, max_lists: int = MAX_LISTS, seed: int = SEED) -> Index:
    """The index of all of ``n`` usable ``rows(row, id, vector)``. The sample is chosen by a hash of id and vector."""
    single = rows.schema["vector"].dataType.elementType == T.FloatType()
    lists = min(max_lists, math.ceil(math.sqrt(n)), max(1, SAMPLE_BYTES // (4 * size) // 4))
    wanted = min(n, SAMPLE_PER_LIST * lists, max(lists, SAMPLE_BYTES // (4 * size)))
    key = F.xxhash64("id", "vector")
    chosen = rows.select(key.alias("key"), "row", "vector").filter(F.shiftrightunsigned("key", 33) < int(wanted / n * (1 << 31)) + 1)
    table = chosen.limit(2 * wanted).toArrow().combine_chunks().sort_by([("key", "ascending"), ("row", "ascending")])
    sample = unit(matrix(table["vector"].combine_chunks(), size))
    if len(sample) < lists:  # by chance, of very few rows
        sample = unit(matrix(rows.select("vector").limit(wanted).toArrow()["vector"].combine_chunks(), size))
    centroids = fitted(sample, min(lists, len(sample)), seed=seed)
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack = packs(batch, size)
            at, near = nearest_list(unit(pack.vector), sent.value)
            order = np.argsort(at, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []
            parts = [g[s : s + PACK_ROWS] for g in groups for s in range(0, len(g), PACK_ROWS)]
            if parts:
                out = packed([(int(at[p[0]]), 0, 0, pack.take(p)) for p in parts])
                yield out.append_column("n", pa.array([len(p) for p in parts])).append_column("near", pa.array([float(near[p].sum()) for p in parts]))

    placed = materialized(rows.mapInArrow(assign, f"{PACKED}, n long, near double"))
    stats = placed.groupBy("list").agg(F.sum("n").alias("n"), F.sum("near").alias("near")).collect()  # at most max_lists rows
    sizes, sums = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in stats:
        sizes[r["list"]], sums[r["list"]] = r["n"], r["near"]
    blocks = -(-sizes // max(1, BLOCK_BYTES // (4 * size)))
    of_list = F.element_at(F.lit(blocks.tolist()), F.col("list") + 1)
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("row"), of_list).cast("int")).drop("n", "near")
    return Index(Lists(centroids, sizes, sums / np.maximum(sizes, 1), blocks), dealt, size, single)


def first_lists(cosine: np.ndarray, lists: Lists, k: int, least: int = FIRST_LISTS) -> np.ndarray:
    """Which lists each query looks into first: the nearest, ``least`` and until they hold more than k vectors."""
    order = np.argsort(-cosine, axis=1, kind="stable")
    before = np.cumsum(lists.sizes[order], axis=1) - lists.sizes[order]
    take = (np.arange(cosine.shape[1]) < least) | (before <= k)
    wanted = np.zeros(cosine.shape, bool)
    np.put_along_axis(wanted, order, take, axis=1)
    return wanted & (lists.sizes > 0)


def further_lists(cosine: np.ndarray, floor: np.ndarray, lists: Lists, size: int, k: int, missed: float, least: int = FIRST_LISTS) -> np.ndarray:
    """Which lists each query looks into besides: all but those that together should hold ``missed * k`` vectors above its floor.

    A vector at cosine c to its centroid, in a direction of chance, has a cosine to the query of mean ``cosine * c`` and of a
    spread that the dimensions make small. A query without a floor looks into all lists, as does one that may miss none.
    """
    spread = np.sqrt(np.maximum((1 - cosine**2) * (1 - lists.near**2), 1e-12) / max(size - 1, 1))
    z = (floor[:, None] - cosine * lists.near) / spread
    t = 1 / (1 + 0.2316419 * np.abs(z))  # the normal distribution's tail, to 1e-7
    tail = np.exp(-0.5 * z**2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    above = lists.sizes * np.where(z < 0, 1 - tail, tail)
    order = np.argsort(above, axis=1, kind="stable")
    left_out = np.cumsum(np.take_along_axis(above, order, axis=1), axis=1) <= missed * k
    wanted = np.ones(cosine.shape, bool)
    np.put_along_axis(wanted, order, ~left_out, axis=1)
    wanted |= (missed <= 0) | np.isneginf(floor)[:, None]
    return wanted & (lists.sizes > 0) & ~first_lists(cosine, lists, k, least)


def query_packs(queries: DataFrame, index: Index, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``queries(row, id, vector, floor)`` packed for every block of the lists that ``choose`` names for them."""
    sent, size = queries.sparkSession.sparkContext.broadcast(tuple(index.lists)), index.size  # classes in broadcasts go by name

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(*sent.value)
        for whole_batch in batches:
            for s in range(0, whole_batch.num_rows, PACK_ROWS):
                batch = whole_batch.slice(s, PACK_ROWS)
                own = packs(batch, size, batch.column("floor").to_numpy())
                wanted = choose(unit(own.vector) @ lists.centroids.T, own.floor)
                rows, held = [], 0
                for at in np.flatnonzero(wanted.any(axis=0)).tolist():
                    part = own.take(np.flatnonzero(wanted[:, at]))
                    for b in range(int(lists.blocks[at])):
                        rows.append((at, b, 1, part))
                        held += part.vector.nbytes
                        if held > BLOCK_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return queries.select("row", "id", "vector", "floor").mapInArrow(pack, PACKED)


def best_of(pairs: Pairs, block: Pack, queries: Pack, k: int) -> np.ndarray:
    """Which of the pairs (query, vector, score) are among the query's best k that reach its floor; ties by id, nulls last."""
    q, v, score = pairs
    ok = np.flatnonzero((score >= queries.floor[q]) & (queries.row[q] != block.row[v]))
    order = ok[np.lexsort((block.row[v[ok]], block.id[v[ok]], ~block.known[v[ok]], -score[ok], q[ok]))]
    start = np.flatnonzero(np.append(True, np.diff(q[order]) != 0)) if len(order) else np.empty(0, np.int64)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < k]


def least_of_best(near: np.ndarray, k: int) -> np.ndarray:
    """For each row the least of its k + 1 largest, since one may be the query itself."""
    n = near.shape[1]
    return np.partition(near, n - k - 1, axis=1)[:, n - k - 1] if n > k + 1 else np.full(len(near), -np.inf)


def scan_all(block: Pack) -> Callable[[Pack, int], Pairs]:
    """Every vector of the block against every query in single precision, exact scores for those that may be among the best."""
    own = unit(block.vector)

    def compare(queries: Pack, k: int) -> Pairs:
        near = unit(queries.vector) @ own.T
        q, v = np.nonzero(near >= np.maximum(least_of_best(near, k), queries.floor)[:, None] - ROUNDING)
        return q, v, cosines(queries.vector, block.vector, q, v)

    return compare


class Block:
    """One block: its distinct vectors, and for each the rows that have it, by id."""

    def __init__(self, parts: list[Pack]):
        pack = Pack(*map(np.concatenate, zip(*parts, strict=True)))
        self.rows = pack.take(np.lexsort((pack.row, pack.id, ~pack.known)))
        raw = np.ascontiguousarray(self.rows.vector)
        _, first, self.kind = np.unique(raw.view(np.dtype((np.void, raw.shape[1] * raw.itemsize))).ravel(), return_index=True, return_inverse=True)
        self.distinct = self.rows.take(first)
        self.order = np.argsort(self.kind, kind="stable")
        self.ends = np.cumsum(np.bincount(self.kind))

    def copies(self, q: np.ndarray, v: np.ndarray, score: np.ndarray, k: int) -> Pairs:
        """Pairs with distinct vectors as pairs with their rows: the first k + 1 rows of each."""
        start = np.append(0, self.ends[:-1])[v]
        n = np.minimum(self.ends[v] - start, k + 1)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(q, n), self.order[np.repeat(start, n) + within], np.repeat(score, n)


def met(index: Index, asked: DataFrame, k: int, scan: Scan) -> DataFrame:
    """What the packs of queries find in the blocks they want: FOUND, at most k rows for a query and block.

    Rows of both kinds are dealt and sorted by (list, block), vectors first: a task gathers a block, then the packs go
    by one at a time.
    """
    size, single = index.size, index.single

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, block, compare = None, [], None, None
        for batch in batches:
            place = list(zip(*(batch.column(c).to_pylist() for c in ("list", "block", "side")), strict=True))
            for i, (at, part, side) in enumerate(place):
                if (at, part) != name:
                    name, parts, block = (at, part), [], None
                pack = unpacked(batch, i, size, single)
                if side == 0:
                    parts.append(pack)
                    continue
                if block is None and parts:
                    block, parts = Block(parts), []
                    compare = scan(block.distinct)
                if block is None:
                    continue
                pairs = block.copies(*compare(pack, k), k)
                best = best_of(pairs, block.rows, pack, k)
                q, v, score = (x[best] for x in pairs)
                if len(q):
                    found = [pack.row[q], pa.array(pack.id[q], mask=~pack.known[q]), block.rows.row[v], pa.array(block.rows.id[v], mask=~block.rows.known[v]), score]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in found], [c.split()[0] for c in FOUND.split(", ")])

    sides = index.rows.unionByName(asked)
    return sides.repartition("list", "block").sortWithinPartitions("list", "block", "side").mapInArrow(meet, FOUND)


def best_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def searched(index: Index, queries: DataFrame, k: int, scan: Scan, missed: float = MISSED, first: int = FIRST_LISTS) -> DataFrame:
    """query_row, query_id, rank, row, id, score: the k nearest of each of ``queries(row, id, vector)``, as found in two steps."""
    lists, size, none = index.lists, index.size, F.lit(float("-inf"))
    queries = materialized(queries.repartition(max(1, -(-queries.count() // PACK_ROWS))))
    begun = met(index, query_packs(queries.withColumn("floor", none), index, lambda c, floor: first_lists(c, lists, k, first)), k, scan)
    begun = materialized(best_rows(begun, k).drop("rank"))
    floors = begun.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(none).alias("floor"))
    told = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", none))
    more = met(index, query_packs(told, index, lambda c, floor: further_lists(c, floor, lists, size, k, missed, first)), k, scan)
    return best_rows(begun.unionByName(more), k).select("query_row", "query_id", "rank", "row", "id", "score")


def nearest(vectors: DataFrame, asked: Column | str, k: int, prepared: Callable[[int], Scan] = lambda size: scan_all, missed: float = MISSED, id_col: str = "id", vector_col: str = "vector", max_lists: int = MAX_LISTS, first: int = FIRST_LISTS) -> DataFrame:
    """query_row, query_id, rank, row, id, score: the k rows of ``vectors`` nearest to each row that ``asked`` picks (by ``id``).

    The score is the cosine of the vectors as they are, in double precision; a row is not found for itself, but for other rows
    of its id. Ties go to the smaller id, null ids last. Rows are left out as usable() says. With ``missed`` 0 all lists
    are looked into. ``prepared`` makes the scan from the number of components.
    """
    rows, size = usable(vectors, id_col, vector_col)
    if not (n := rows.count()):
        return rows.sparkSession.createDataFrame([], f"{FOUND}, rank int").select("query_row", "query_id", "rank", "row", "id", "score")
    return searched(build_index(rows, size, n, max_lists), rows.filter(asked), k, prepared(size), missed, first)


def nearest_to(queries: DataFrame, vectors: DataFrame, k: int, missed: float = MISSED, max_lists: int = MAX_LISTS, first: int = FIRST_LISTS) -> DataFrame:
    """query_id, chunk_id, rank, score: the k of ``vectors(chunk_id, embedding)`` nearest to each of ``queries(query_id, query_embedding)``.

    Ids may be of any type and each row counts by itself; ties go to the row that comes first in ``vectors`` as read. Queries with unusable vectors,
    or of another number of components, find nothing.
    """
    number = F.monotonically_increasing_id()
    named = materialized(vectors.select(number.alias("_id"), "chunk_id", "embedding"))
    asked = materialized(queries.select(number.alias("_id"), "query_id", "query_embedding"))
    rows, size = usable(named, "_id", "embedding")
    own, query_size = usable(asked, "_id", "query_embedding")
    kinds = named.select("chunk_id").schema, asked.select("query_id").schema
    if not (n := rows.count()) or query_size != size:
        return named.sparkSession.createDataFrame([], T.StructType([*kinds[1], *kinds[0], T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    own = own.select((-1 - F.col("row")).alias("row"), "id", F.col("vector").cast(rows.schema["vector"].dataType).alias("vector"))
    found = searched(build_index(rows, size, n, max_lists), own, k, scan_all, missed, first)
    found = found.join(named.select(F.col("_id").alias("id"), "chunk_id"), "id").join(asked.select(F.col("_id").alias("query_id"), F.col("query_id").alias("_name")), "query_id")
    return found.select(F.col("_name").alias("query_id"), "chunk_id", "rank", "score")


def best_products(queries: np.ndarray, block: np.ndarray, k: int) -> Pairs:
    """The k largest inner products of each query with the block's vectors; of equal ones those that come first.

    A product of matrices finds what may be among them, its error being bounded by the vectors' sizes; scores are sums over the
    components in order.
    """
    near, size = queries @ block.T, queries.shape[1]
    slack = 1e-15 * size**2 * np.abs(queries).max(initial=0.0) * np.abs(block).max(initial=0.0)
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if k < near.shape[1] else np.full(len(near), -np.inf)
    q, v = np.nonzero(near >= least[:, None] - slack)
    score = np.zeros(len(q))
    for d in range(size):
        score += queries[q, d] * block[v, d]
    order = np.lexsort((v, -score, q))
    q, v, score = q[order], v[order], score[order]
    start = np.searchsorted(q, q)
    kept = np.arange(len(q)) - start < k
    return q[kept], v[kept], score[kept]


def largest_products(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, chunk_id, score of the k of ``vectors(chunk_id, embedding)`` with the largest inner product, by brute force.

    All vectors meet all of ``queries(query_id, query_embedding)``: vectors are dealt into blocks, in each by id, and queries go to every
    block, after it; a task holds one block and some queries. Ties go to the smaller chunk_id. Vectors must be finite and of one size.
    """
    size = queries.select(F.size("query_embedding")).first()[0]
    blocks = max(1, -(-vectors.count() // block_rows))
    vector = lambda c: F.col(c).cast("array<double>").alias("vector")
    none = lambda c, rows: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    dealt = vectors.select(F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), none("query_id", queries), "chunk_id", vector("embedding"))
    everywhere = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "query_id", none("chunk_id", vectors), vector("query_embedding"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, ids, own = None, [], None, None
        for batch in batches:
            place = batch.column("block").to_numpy() * 2 + batch.column("side").to_numpy()
            cuts = np.flatnonzero(np.append(True, np.diff(place) != 0)) if len(place) else np.empty(0, np.int64)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(place)], strict=False):
                if place[a] // 2 != name:
                    name, parts, own = place[a] // 2, [], None
                if place[a] % 2 == 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                if own is None and parts:
                    ids, own, parts = pa.concat_arrays([p.column("chunk_id") for p in parts]), np.concatenate([matrix(p.column("vector"), size) for p in parts]), []
                for s in range(a, b, PACK_ROWS) if own is not None else ():
                    some = batch.slice(s, min(PACK_ROWS, b - s))
                    q, v, score = best_products(matrix(some.column("vector"), size), own, k)
                    yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(q)), ids.take(pa.array(v)), pa.array(score)], ["query_id", "chunk_id", "score"])

    both = dealt.unionByName(everywhere).repartition(blocks, "block").sortWithinPartitions("block", "side", "chunk_id")
    found = both.mapInArrow(meet, T.StructType([queries.schema["query_id"], vectors.schema["chunk_id"], T.StructField("score", T.DoubleType())]))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")
