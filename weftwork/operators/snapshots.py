"""What changed between two states of a table: inserts, updates and deletes by key, from hashes of the contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_of(*columns: str | Column) -> Column:
    """A digest of the columns' values and names; nulls count, and maps do in the order in which they are written."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changes(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """key, change (insert, update, delete) of all keys whose rows differ; both tables have the key and ``content``.

    One full outer join of a row for each key. Keys may repeat: then all their contents count, whatever their order. A null key
    is a key like any other.
    """
    bits = F.xxhash64("content")
    state = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(bits).alias("mixed"), F.bit_xor(F.xxhash64(bits, F.lit(1))).alias("again"), F.max("content").alias("last"))
    before, after = (df.groupBy(F.col(key).alias(f"_{name}")).agg(state.alias(name)) for df, name in ((old, "old"), (new, "new")))
    both = before.join(after, F.col("_old").eqNullSafe(F.col("_new")), "full")
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update")
    return both.select(F.coalesce("_new", "_old").alias(key), kind.alias("change")).filter("change is not null")
