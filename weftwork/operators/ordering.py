"""A total order of a table without a task that sees all of it: sorted ranges, numbered by the sizes of those before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.storage import materialized


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` in partitions that follow each other in ``order``, each sorted: written out, the files are in order by name.

    Rows that are alike in the order stand together, in any order. ``df`` is written once, since Spark looks at a sample of it first.
    """
    return materialized(df).repartitionByRange(*order).sortWithinPartitions(*order)


def numbered(df: DataFrame, *order: str | Column, name: str = "nth") -> DataFrame:
    """``df`` with each row's place in ``order``, from 1; rows alike in the order are numbered in any way.

    A row knows its range and its place in it; the sizes of the ranges, a number each, come to the driver.
    """
    placed = materialized(in_ranges(df, *order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _before long"))
    return placed.join(offsets, part == F.col("_part")).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + within + 1).alias(name))
