"""Sharding by a two-pass external shuffle: seeded scatter into memory-sized buckets, then Fisher-Yates in each.

Spark's shuffle() of an array is a Fisher-Yates whose draws follow from the seed and the partition's number. A bucket's
partition is therefore its own number, taken as it is (repartitionById), and not what a hash and a setting make of
it: the order depends on the rows, the seed and the sizes alone, with adaptive execution or without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import cut, if_small, whole

SHARDS = 8
SEED = 42
#: Bytes of text and rows that a bucket holds on average; a bucket is shuffled in one task's memory.
BUCKET_BYTES = 32 << 20
#: What a row takes in a bucket besides its text, about.
ROW_BYTES = 64
#: Tasks of the second pass, at most; beyond, a task shuffles several buckets, one after the other.
MAX_TASKS = 1 << 15


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard whose seeded hash with the key is largest.

    Only the key and the number of shards decide; one more shard takes rows only into itself. Null keys
    share a shard.
    """
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("draw"), F.lit(i).alias("shard")) for i in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["shard"]


def bucketed(rows: DataFrame, total_bytes: int, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """First pass. ``rows(doc_id, size, text_crc32, at, ...)`` with shard, grown_shard and a bucket within the shard; buckets of a shard.

    The number of buckets follows the bytes, so that a bucket fits in memory at every input size. The hash
    of a bucket takes the text's checksum too: rows that share an id still scatter. Rows that are alike in all
    of these and too many for a bucket are dealt by their place in the table.
    """
    buckets = max(1, -(-total_bytes // (shards * bucket_bytes)))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), shards, seed)).withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1, seed))
    if buckets == 1:
        return rows.withColumn("bucket", F.lit(0).cast("long")), 1
    rows = rows.withColumn("_alike", F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    many = cut(rows.groupBy("_alike").agg(F.sum(F.col("size") + ROW_BYTES).alias("bytes"), F.count(F.lit(1)).alias("n")).filter((F.col("bytes") > bucket_bytes) & (F.col("n") > 1)).select(F.col("_alike").alias("_many")))
    dealt = rows.join(if_small(many), F.col("_alike") == F.col("_many"), "left").withColumn("bucket", F.pmod(F.when(F.col("_many").isNull(), F.col("_alike")).otherwise(F.xxhash64("_alike", "at")), F.lit(buckets)))
    return dealt.drop("_alike", "_many"), buckets


def placed(rows: DataFrame, buckets: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Second pass: a Fisher-Yates shuffle of each bucket gives ``slot``, gapless from 0 in each shard.

    A bucket's rows are put in order before the shuffle and the buckets of a task too, so a task that is run
    again, on another executor, gives the same slots. All columns of ``rows`` must be orderable (no maps).
    """
    tasks = min(shards * buckets, MAX_TASKS)
    dealt = rows.drop("at").withColumn("task", F.pmod(F.col("shard") * F.lit(buckets).cast("long") + F.col("bucket"), F.lit(tasks)).cast("int"))
    row = F.struct("doc_id", "text_crc32", *[c for c in rows.columns if c not in ("doc_id", "text_crc32", "shard", "bucket", "at")])
    ordered = dealt.repartitionById(tasks, "task").groupBy("task", "shard", "bucket").agg(F.array_sort(F.collect_list(row)).alias("rows")).sortWithinPartitions("shard", "bucket")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")))
    shuffled = ordered.select("shard", "bucket", F.shuffle("rows", seed).alias("rows"))
    return (
        shuffled.join(if_small(starts, 1_000_000), ["shard", "bucket"])
        .select("shard", "bucket", "start", F.posexplode("rows").alias("nth", "row"))
        .select("shard", "bucket", (F.col("start") + F.col("nth")).alias("slot"), "row.*")
    )


def digests(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), the text's unsigned CRC-32 (a null text is empty), and the row's place."""
    text = whole("text")
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("at"), *more)


def laid_out(rows: DataFrame, shards: int, seed: int, bucket_bytes: int) -> DataFrame:
    total = rows.agg(F.coalesce(F.sum(F.col("size") + ROW_BYTES), F.lit(0))).first()[0]
    dealt, buckets = bucketed(rows, total, shards, seed, bucket_bytes)
    return placed(dealt, buckets, shards, seed)


def shard_plan(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, grown_shard, bucket, slot.

    Texts are read once, for size and checksum, and are not shuffled. Null ids and texts are kept, and null ids
    share a shard; repeated rows each get a slot, and copies of a text scatter over the buckets; an empty table
    gives an empty plan. Reruns agree, whatever the partitions of the table, but for rows that are alike in id, text
    and size and more than a bucket holds: these need the same table.
    """
    return laid_out(cut(digests(docs)), shards, seed, bucket_bytes)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write whole records as Parquet, a folder per shard, a sorted run of slots per bucket.

    Nulls, repeated rows and the order are as in shard_plan(); records may have columns of any names, but no
    maps; of an empty table nothing is written but the table's schema.
    """
    laid = laid_out(digests(docs, F.struct("*").alias("record")), shards, seed, bucket_bytes)
    laid.select("shard", "bucket", "slot", "record").sortWithinPartitions("shard", "bucket", "slot").write.partitionBy("shard").parquet(path)


def op10(docs: DataFrame) -> DataFrame:
    return shard_plan(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
