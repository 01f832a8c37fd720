"""The index as a stream: new chunk files are embedded and upserted by stable id; a checkpoint says what is done."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions.text import tokenize
from weftwork.operators.indexing import embedding_text, stable_point_id
from weftwork.operators.snapshots import changes, content_of
from weftwork.streaming.progress import BatchEvents

#: Buckets of the index by point id: an upsert rewrites only those that a batch touches.
BUCKETS = 64


def hashing_vector(text: Column, dimensions: int = 384) -> Column:
    """A unit vector of hashed tokens, the stand-in for a sentence encoder where no model is at hand."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for places in batches:
            out = []
            for at in places:
                v = np.bincount(np.asarray(at, dtype=np.int64), minlength=dimensions).astype(np.float32)
                out.append(v / (np.linalg.norm(v) or 1))
            yield pd.Series(out)

    return encode(F.transform(tokenize(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int")))


def staged_points(chunks: DataFrame) -> DataFrame:
    """Points without vectors: id, bucket, the text to embed, payload and content; of repeated ids in a batch the last one's.

    ``content`` is a digest of the payload, by which a later state of the chunks is compared with this one.
    """
    point = stable_point_id(F.col("chunk_id"))
    rows = chunks.select(point.alias("point_id"), embedding_text(chunks).alias("_text"), F.struct(*chunks.columns).alias("payload"))
    one = rows.groupBy("point_id").agg(F.max_by(F.struct("_text", "payload"), F.struct("payload.chunk_index", F.col("_text"))).alias("r"))
    return one.select("point_id", bucket_of("point_id"), F.col("r._text").alias("_text"), "r.payload", content_of("r.payload").alias("content"))


def bucket_of(point_id: str) -> Column:
    return F.pmod(F.xxhash64(point_id), F.lit(BUCKETS)).cast("int").alias("bucket")


def embedded(staged: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    return staged.select("point_id", "bucket", "payload", encode(F.col("_text")).alias("vector"), "content", F.lit(False).alias("deleted"))


def points_of(chunks: DataFrame, encode: Callable[[Column], Column] = hashing_vector) -> DataFrame:
    """Index points: id, bucket, payload, vector, content of each chunk; ``deleted`` is false."""
    return embedded(staged_points(chunks), encode)


def live_points(index: DataFrame) -> DataFrame:
    """The index without what has been deleted from it."""
    return index.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in index.columns else index


def sync_into(chunks: DataFrame, index: str, encode: Callable[[Column], Column] = hashing_vector) -> dict[str, int]:
    """Make the index what ``chunks`` are now; returns the numbers of inserts, updates and deletes.

    Contents are compared by digest, so that only what is new or has changed is embedded and only its buckets are
    written; without changes nothing is. What is gone leaves a point without payload that is marked as deleted, so that a
    bucket is rewritten even where nothing is left in it.
    """
    spark = chunks.sparkSession
    staged = staged_points(chunks).select("point_id", "bucket", "_text", "payload", "content")
    before = live_points(spark.read.parquet(index)) if exists(spark, index) else None
    known = before.select("point_id", "content") if before is not None and "content" in before.columns else staged.select("point_id", "content").limit(0) if before is None else before.select("point_id", F.lit(None).cast("string").alias("content"))
    found = changes(known, staged.select("point_id", "content"), "point_id").checkpoint()
    counts = {c: 0 for c in ("insert", "update", "delete")} | {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
    if any(counts.values()):
        fresh = embedded(staged.join(found.filter("change <> 'delete'"), "point_id", "left_semi"), encode)
        gone = found.filter("change = 'delete'").select("point_id", bucket_of("point_id"), *[F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in ("payload", "vector", "content")], F.lit(True).alias("deleted"))
        upsert_into(fresh.unionByName(gone), index)
    return counts


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def upsert_into(points: DataFrame, index: str) -> None:
    """Points replace those of the same id in the index table; only the buckets concerned are read and written.

    The new state of those buckets is checkpointed before it overwrites what it was read from. Done again, the
    same points give the same table.
    """
    spark = points.sparkSession
    points = points.checkpoint()
    touched = [r["bucket"] for r in points.select("bucket").distinct().collect()]  # BUCKETS at most
    if not touched:
        return
    if exists(spark, index):
        old = spark.read.schema(points.schema).parquet(index).filter(F.col("bucket").isin(touched))
        points = old.join(points.select("point_id"), "point_id", "left_anti").unionByName(points).checkpoint()
    points.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(index)


def index_stream(spark: SparkSession, chunks: str, index: str, checkpoint: str, encode: Callable[[Column], Column] = hashing_vector, files_per_batch: int = 64, tell: Callable[[dict], None] | None = None) -> list[dict]:
    """Take the chunk files that are new since the last call into the index, in batches, and stop; returns an event a batch.

    A batch that was cut off is done again whole; the ids make that harmless. A new checkpoint folder starts over. Events are
    passed to ``tell`` as they come.
    """
    if files_per_batch <= 0:
        raise ValueError("files of a batch must be above zero")
    rows = spark.readStream.schema(spark.read.parquet(chunks).schema).option("maxFilesPerTrigger", files_per_batch).parquet(chunks)
    took = lambda batch, _: upsert_into(points_of(batch, encode), index)
    listener = BatchEvents(f"index-{uuid.uuid4().hex}", tell)
    spark.streams.addListener(listener)
    try:
        rows.writeStream.queryName(listener.name).foreachBatch(took).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        listener.over.wait(10)  # seconds: events come on a thread of their own
    finally:
        spark.streams.removeListener(listener)
    return listener.events
