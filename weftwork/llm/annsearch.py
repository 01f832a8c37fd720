"""Approximate nearest neighbours: the lists of an inverted-file index, scanned by dimensions that adapt to each vector.

Vectors are rotated at random and laid out in blocks of columns. After each block of columns a test asks whether a vector
with so small a part of the inner product can still be as near as the query's k-th nearest so far; where that is
unlikely the vector is abandoned, and its other columns are not read. Which lists are probed, and the exact scores of what is
found, are the index's matter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators.vectors import ROUNDING, Pack, Pairs, Scan, cosines, least_of_best, nearest, unit

K = 5
#: Columns of one block.
WIDTH = 16
#: A vector is abandoned when its part is so many standard deviations below what one as near as the k-th would have.
DEVIATIONS = 2.6
#: Vectors of a list that are read whole, for a first k-th nearest.
READ_WHOLE = 256
#: Pairs of a query and a vector that are looked at together.
PAIRS = 1 << 20
SEED = 42


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of ``size`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def least_parts(floor: np.ndarray, energy: np.ndarray, size: int, deviations: float = DEVIATIONS) -> np.ndarray:
    """The least part of the inner product at which a vector is kept, for queries with ``energy`` of their length in the part.

    A unit vector at cosine f to the query is f times the query and a vector across it, whose direction the rotation has
    made random: its part has the mean ``f * energy`` and the variance ``(1 - f * f) * energy * (1 - energy) / (size - 1)``.
    """
    f = np.clip(floor, -1, 1)
    limit = f * energy - deviations * np.sqrt((1 - f * f) * np.maximum(energy * (1 - energy), 0) / max(size - 1, 1)) - ROUNDING
    return np.where(np.isneginf(floor), -np.inf, limit)


def adaptive(size: int, width: int = WIDTH, deviations: float = DEVIATIONS, seed: int = SEED) -> Scan:
    """Scans blocks of vectors of ``size`` components, ``width`` columns at a time."""
    turn, edges = rotation(size, seed), [*range(0, size, width), size]

    def scan(block: Pack) -> Callable[[Pack, int], Pairs]:
        turned = unit(block.vector) @ turn
        columns = [np.ascontiguousarray(turned[:, a:b].T) for a, b in zip(edges, edges[1:], strict=False)]
        n = len(turned)

        def some(own: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            parts = [own[:, a:b] for a, b in zip(edges, edges[1:], strict=False)]
            energy = np.cumsum([np.einsum("ij,ij->i", p, p) for p in parts], axis=0)
            near = parts[0] @ columns[0]
            q, v = np.nonzero(near >= least_parts(floor, energy[0], size, deviations)[:, None])
            near = near[q, v]
            for part, column, e in zip(parts[1:], columns[1:], energy[1:], strict=True):
                if len(q) * 4 > len(own) * n:
                    near = near + (part @ column)[q, v]
                else:
                    near = near + np.einsum("ij,ji->i", part[q], column[:, v])
                kept = np.flatnonzero(near >= least_parts(floor, e, size, deviations)[q])
                q, v, near = q[kept], v[kept], near[kept]
            kept = near >= floor[q] - ROUNDING
            return q[kept], v[kept]

        def compare(queries: Pack, k: int) -> Pairs:
            own, found, step = unit(queries.vector) @ turn, [], max(1, PAIRS // n)
            for s in range(0, len(own), step):
                part = own[s : s + step]
                floor = np.maximum(queries.floor[s : s + step], least_of_best(part @ turned[:READ_WHOLE].T, k))
                q, v = some(part, floor)
                found.append((q + s, v))
            q, v = (np.concatenate(x) for x in zip(*found, strict=True))
            return q, v, cosines(queries.vector, block.vector, q, v)

        return compare

    return scan


def nearest_rows(vectors: DataFrame, asked: str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", **search) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that ``asked`` (an expression of ``id``) picks.

    Nearness is the cosine in double precision, of the vectors as they are. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor those of an uncommon number of components. A row is no candidate of itself; another row of
    its id is, and each row of an id is a query of its own. Ties go to the smaller id, null ids last. An
    empty table gives no rows.
    """
    found = nearest(vectors, asked, k, prepared=adaptive, id_col=id_col, vector_col=vector_col, **search)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op12(embeddings: DataFrame) -> DataFrame:
    return nearest_rows(embeddings, "id % 50 = 0")
