"""Exact deduplication by a stateful stream: disk-backed keyed state, full bytes compared on hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import cut, delete, if_small, located, shared_path, whole

#: Input that one micro-batch reads at most.
MAX_BYTES_PER_TRIGGER = 1 << 40
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # a store is closed soon after its stream has ended
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk ahead of need
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keyed(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text, digest and the content's locator: file and row in it."""
    at = rows.metadataColumn("_metadata")
    text = whole(text_col)
    return rows.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest(text).alias("digest"), at["file_path"].alias("file"), at["row_index"].alias("row"))


def stream_state(spark: SparkSession, path: str, state_dir: str, entries: Callable[[DataFrame], DataFrame] | None = None, **options: str | int) -> None:
    """Take what is new below ``path`` into the keyed state in ``state_dir``, and stop.

    ``entries`` makes doc_id, digest, file and row of the rows that are read (by default from the columns doc_id
    and text). State is one entry per digest in RocksDB, never expired: the number of rows, and the stable
    identifier and content locator of the row that stays (largest id, then largest locator). Rows are combined by
    digest before the shuffle, so that a group of copies reaches its state as one row from each task. A later
    call with the same folder goes on where this one ended.
    """
    entries = entries or (lambda rows: keyed(rows, "doc_id", "text", sha256))
    session = spark.newSession()
    for key, value in (STATE_CONF | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        session.conf.set(key, value)
    options = options or {"maxBytesPerTrigger": MAX_BYTES_PER_TRIGGER}
    name = path.rstrip("/")
    one_of = f"{name[:-1]}[{name[-1]}]"  # a stream takes a folder, or a pattern; a pattern may fit one file too
    rows = session.readStream.schema(session.read.parquet(path).schema).options(**options).parquet(one_of)
    state = entries(rows).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
    state.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The state: digest, n, keep_id, keep_file, keep_row."""
    entries = spark.read.format("statestore").load(state_dir).select("key.*", "value.*").toDF("digest", "n", "keep")
    return entries.select("digest", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"))


def streamed_state(spark: SparkSession, path: str, entries: Callable[[DataFrame], DataFrame], **options: str | int) -> DataFrame:
    """The state after all of ``path``, kept for this run alone."""
    state_dir = shared_path(spark, "dedup-state")
    stream_state(spark, path, state_dir, entries, **options)
    state = cut(read_state(spark, state_dir))
    delete(spark, state_dir)
    return state


def groups_of(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One row per row of ``rows(doc_id, text, digest, file, row)``: doc_id, keep_id, group_size, kept, digest, file, row.

    The state says which digests occur more than once; only their texts are read again and compared, byte by
    byte, with the text at the locator. Texts that share a digest and differ are grouped by digest and text.
    """
    single = state.filter("n = 1").select(F.col("keep_id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.lit(True).alias("kept"), "digest", F.col("keep_file").alias("file"), F.col("keep_row").alias("row"))
    hits = rows.join(if_small(state.filter("n > 1")), "digest")
    stays = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    content = hits.filter(stays).select(F.col("digest").alias("_digest"), F.col("text").alias("_text"))
    same = F.coalesce(F.col("text") == F.col("_text"), F.lit(False))
    checked = cut(
        hits.join(content, F.col("digest") == F.col("_digest"), "left").select("doc_id", "keep_id", "n", stays.alias("kept"), same.alias("same"), "digest", "file", "row")
    )
    odd = checked.filter("not same").select("file", "row")
    if odd.isEmpty():
        return single.union(checked.select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", "digest", "file", "row"))
    matches = checked.filter("same").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    matched = checked.filter("same").join(matches, "digest").select("doc_id", "keep_id", "group_size", "kept", "digest", "file", "row")
    apart = rows.join(odd, ["file", "row"], "left_semi")
    groups = apart.groupBy(F.col("digest").alias("_digest"), F.col("text").alias("_text")).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
    regrouped = apart.join(groups, (F.col("digest") == F.col("_digest")) & (F.col("text") == F.col("_text"))).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"), "digest", "file", "row"
    )
    return single.union(matched).union(regrouped)


def exact_duplicates(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, **options: str | int) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, digest, file, row.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest doc_id stays;
    null ids are smallest, and of rows that share the id one stays. The table is streamed into the state, and
    groups_of() compares full texts on hits. An empty table gives no rows.
    """
    entries = lambda rows: keyed(rows, id_col, text_col, digest)
    table = spark.read.parquet(path)
    if table.isEmpty():
        return entries(table).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "file", "row")
    return groups_of(entries(table), streamed_state(spark, path, entries, **options))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, **options: str | int) -> DataFrame:
    """The rows of ``docs`` that stay, same columns, which may have any names.

    A stream reads files: digests, ids and locators are written to the shared folder for it, texts are not.
    Only what is dropped is joined away.
    """
    spark, rows = docs.sparkSession, located(docs)
    text = whole(F.col("record")[text_col])
    keys = rows.select(F.col("record")[id_col].alias("doc_id"), text.alias("text"), digest(text).alias("digest"), "file", "row")
    if rows.isEmpty():
        return docs
    staged = shared_path(spark, "dedup-keys")
    keys.drop("text").write.parquet(staged)
    state = streamed_state(spark, staged, lambda read: read, **options)
    delete(spark, staged)
    dropped = groups_of(keys, state).filter("not kept").select("file", "row")
    return rows.join(if_small(dropped), ["file", "row"], "left_anti").select("record.*")


def op5(spark: SparkSession, path: str) -> DataFrame:
    return exact_duplicates(spark, path).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST, r DESC) AS k FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(text) AS text_sha256 FROM g
"""
