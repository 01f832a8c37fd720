"""Filters by bitmap index: for each value of a field the positions of its rows, as bits in buckets of 32,768.

Values of one field are joined by or, fields by and, a bucket at a time; rows are looked at only in the buckets that have
bits left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_of(position: str | Column) -> Column:
    """The bucket of a position, which is a whole number from 0."""
    return F.bitmap_bucket_number(position)


def bitmap_index(rows: DataFrame, position: str, fields: list[str]) -> DataFrame:
    """field, value (as text), bucket, bits of ``rows``; null is a value of its own.

    A bitmap has 4 KB whatever it holds; positions that follow each other fill them. Bits are set where rows lie, before
    the shuffle, so that a value that most rows have is no hot key. Rows without a position are in no bitmap.
    """
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    each = rows.filter(F.col(position).isNotNull()).select(F.col(position).cast("long").alias("_at"), F.inline(values))
    return each.groupBy("field", "value", bucket_of("_at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("bits"))


def selected(index: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """bucket, bits of the rows whose every field of ``wanted`` has one of its values (None: null); no field at all selects all."""
    asked = [(f, None if v is None else str(v)) for f, values in wanted.items() for v in values]
    if not wanted:
        return index.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    spark = index.sparkSession
    pairs = F.broadcast(spark.createDataFrame(asked, "_field string, _value string"))  # as many as the filter names
    own = index.join(pairs, (F.col("field") == F.col("_field")) & F.col("value").eqNullSafe(F.col("_value")), "left_semi")
    per_field = own.groupBy("field", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    every = per_field.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return every.filter((F.col("n") == len(wanted)) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


def has_bit(bits: Column, position: Column) -> Column:
    at = F.bitmap_bit_position(position)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def filtered(rows: DataFrame, position: str, chosen: DataFrame) -> DataFrame:
    """The rows whose position has a bit in ``chosen(bucket, bits)``, by a join on the bucket."""
    bits = chosen.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    at = F.col(position).cast("long")
    return rows.join(bits, bucket_of(at) == F.col("_bucket")).filter(has_bit(F.col("_bits"), at)).drop("_bucket", "_bits")
