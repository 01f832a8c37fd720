"""Connected components of an edge table: rounds of hooking and contraction, until one task can hold what is left."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import PART_ROWS, counted_cut


def to_roots(hooks: DataFrame) -> DataFrame:
    """``hooks(node, to)``, each to a smaller node, with the end of each path instead of its first step.

    Paths halve in each round; a round more finds that none is left.
    """
    moved = 1
    while moved:
        up = hooks.select(F.col("node").alias("to"), F.col("to").alias("_up"))
        jumped = hooks.join(up, "to", "left").select("node", F.coalesce("_up", "to").alias("to"), F.col("_up").isNotNull().alias("moved"))
        jumped, moved = counted_cut(jumped, F.col("moved"))
        hooks = jumped.select("node", "to")
    return hooks


def joined_at_once(links: DataFrame) -> DataFrame:
    """Hooks (node, to) of the few ``links(a, b)`` that are left, each to the smallest node of its component, by one task."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while x in above:
                if (up := above[x]) in above:
                    above[x] = above[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
        nodes = list(above)
        yield pd.DataFrame({"node": nodes, "to": [root(x) for x in nodes]}, dtype="int64")

    return links.coalesce(1).mapInPandas(join, "node long, to long")


def contracted(links: DataFrame, hooks: DataFrame) -> DataFrame:
    """Links between the roots of what ``hooks`` has put together; those within one are gone, repeats too."""
    at = lambda c: hooks.select(F.col("node").alias(c), F.col("to").alias(f"_{c}"))
    moved = links.join(at("b"), "b", "left").join(at("a"), "a", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    return ordered(moved)


def ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def connected_components(edges: DataFrame, at_once: int = PART_ROWS) -> DataFrame:
    """``edges(a, b)`` -> one row per node that is linked to another: node, label (the smallest node that it reaches).

    Every round each node hooks to its smallest neighbour that is smaller than itself (a groupBy with partial
    minima, so a hub's links are combined before the shuffle), paths are followed to their roots, and the links
    are carried over to the roots, where most become one or none: a star is gone after one round, and each round
    works on what the last has left. When no more than ``at_once`` links are left, of two numbers each, one task joins
    them. Links and hooks are cut into the shared folder; nothing but numbers of rows reaches the driver.
    """
    links, n = counted_cut(ordered(edges))
    if not n:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    rounds: list[DataFrame] = []
    while n > at_once:
        rounds.append(to_roots(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))))
        links, n = counted_cut(contracted(links, rounds[-1]))
    if n:
        rounds.append(counted_cut(joined_at_once(links))[0])

    def earlier(later: DataFrame, hooks: DataFrame) -> DataFrame:
        """What one round has hooked, with the labels that the rounds after it gave its roots."""
        given = later.select(F.col("node").alias("to"), F.col("label").alias("_label"))
        return hooks.join(given, "to", "left").select("node", F.coalesce("_label", "to").alias("label")).union(later)

    *first, last = rounds
    labels = reduce(earlier, reversed(first), last.select("node", F.col("to").alias("label")))
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
