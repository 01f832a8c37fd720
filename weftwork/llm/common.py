"""Helpers shared by the operators: shared storage, word patterns, null-safe text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the session's ``spark.checkpoint.dir``.

    Where it is unset (tests, local mode) a temporary folder is made; off local mode that is refused,
    since executors would not see it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftwork-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_scratch: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _scratch:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that shared_path() names inside are deleted at the end; nothing that still reads them may be left."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, and read it from there: work behind it is never repeated."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


#: Rows of one part of a table that was counted, about.
PART_ROWS = 1 << 16


def counted_cut(df: DataFrame, marked: Column | None = None, part_rows: int | None = PART_ROWS) -> tuple[DataFrame, int]:
    """cut(df), and the number of its rows, or of those that are ``marked``; counted as they are written.

    The table comes in no more parts than its rows fill (where ``part_rows`` is given): a table that fits one part is
    joined and grouped without a shuffle, and a larger one is dealt as ever.
    """
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("n"), F.count_if(marked if marked is not None else F.lit(True)).alias("marked")]
    out = cut(df.observe(seen, *metrics))
    found = seen.get
    return out.coalesce(max(1, -(-found["n"] // part_rows))) if part_rows else out, found["marked"]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def located(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as record (a struct), with its locator: the file that it is in, and its number there.

    Where ``docs`` is read from files, and no two rows come from one place, that is the rows' own place and
    nothing is written. Any other table (joined, made up, with exploded rows) is written to the shared folder
    first. Either way a row has one locator however often it is computed.
    """

    def placed(rows: DataFrame, record: Column) -> DataFrame:
        at = rows.metadataColumn("_metadata")
        return rows.select(record.alias("record"), at["file_path"].alias("file"), at["row_index"].alias("row"))

    try:
        rows = placed(docs, F.struct("*"))
    except AnalysisException:  # it has no files
        rows = None
    if rows is not None and not rows.groupBy("file", "row").count().filter("file is null or row is null or count > 1").count():
        return rows
    staged = shared_path(docs.sparkSession, "rows")
    docs.select(F.struct("*").alias("record")).write.parquet(staged)
    return placed(docs.sparkSession.read.parquet(staged), F.col("record"))


#: Rows of a table that is broadcast, at most; the tables concerned have rows of at most about 200 bytes.
BROADCAST_ROWS = 100_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows, which are counted; a larger one is shuffled.

    The other side then stays where it is. ``df`` should be cut, so that counting it costs little; its number of
    ``rows`` may be known.
    """
    return F.broadcast(df) if (df.limit(most + 1).count() if rows is None else rows) <= most else df


def whole(text: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: str | Column) -> Column:
    """Number of words of ``WORD``; null has none."""
    return F.coalesce(F.regexp_count(whole(text), F.lit(WORD)), F.lit(0)).cast("long")


#: Bytes of one Arrow batch: whole texts go to Python workers, so a number of rows alone bounds nothing.
BATCH_BYTES = 4 << 20


def texts_for_python(rows: DataFrame) -> DataFrame:
    """``rows``, in a session whose Arrow batches are small: a worker holds few texts at a time."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; for use inside other expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


SPANS = "array<struct<start:long,end:long,text:string>>"


def running_spans(parts: Column, chunk: int = 64) -> Column:
    """Spans (start, end, text) of parts (gap, n, m): each stands ``gap`` behind the one before it and is ``n`` long.

    Offsets are running sums, taken in chunks and then over the chunks, so that very many parts take about
    linear time.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast(SPANS)

    def place(done: Column, x: Column) -> Column:
        begin = done["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), x["m"].alias("text"))
        return F.struct((begin + x["n"]).alias("at"), F.array_append(done["spans"], span).alias("spans"))

    def follow(done: Column, x: Column) -> Column:
        moved = F.transform(x["spans"], lambda s: F.struct((s["start"] + done["at"]).alias("start"), (s["end"] + done["at"]).alias("end"), s["text"].alias("text")))
        return F.struct((done["at"] + x["at"]).alias("at"), F.array_append(done["spans"], moved).alias("spans"))

    first = F.struct(zero.alias("at"), none.alias("spans"))

    def chunked(parts: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(parts) - 1, F.lit(0)) / chunk).cast("int"))
        return F.transform(starts, lambda i: F.aggregate(F.slice(parts, i * chunk + 1, F.lit(chunk)), first, place))

    chunks = let(parts, chunked)
    return F.flatten(F.aggregate(chunks, F.struct(zero.alias("at"), F.array().cast(f"array<{SPANS}>").alias("spans")), follow)["spans"])
