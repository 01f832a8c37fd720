"""Tables that are used more than once: computed once, kept where every executor can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, short ones, of a table that may go to all executors.
FEW = 100_000
#: Bytes of one Arrow batch of texts: a number of rows alone bounds nothing.
BATCH_BYTES = 4 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; unset, in local mode only, a temporary folder."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="weftwork-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialized(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder now; what reads it never computes it again."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Python workers get few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def joinable(df: DataFrame, few: int | None = None) -> DataFrame:
    """``df``, written and counted, for the right side of a join: broadcast if it has few rows, else never.

    Spark's own estimate goes by the compressed size of the files, and does not know what explode() makes of them.
    """
    df = materialized(df)
    return F.broadcast(df) if df.count() <= (FEW if few is None else few) else df.hint("merge")
