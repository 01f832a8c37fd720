"""Conversation prefix trie: shared prefixes of rebuilt conversations, totals by leaf-peeling message passing.

A node is a distinct sequence of first turns. It is known by 128 bits, the exclusive or of a hash of each (place, turn) in it,
which a running sum gives in one pass over all turns in order. Nodes on one path that the same conversations share are one
chain, named by its smallest member and its number of members; chains, not nodes, exchange messages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.common import PART_ROWS, counted_cut, cut, whole

#: Conversations share the start of the first of so many.
FAMILY = 5
#: Turns of a rebuilt conversation that come from there: fewer than this.
HEADS = 9
EMPTY = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, str], xors: dict[str, str]) -> DataFrame:
    """``rows`` with running sums and exclusive ors of long columns, within each ``key`` (a long, not null), in order.

    The rows are sorted by ranges of (key, order), so that a key of any size is spread over tasks. A task runs through
    its range, holding one batch; what the last key of a range has come to is carried on to the next ranges: a row
    for each partition goes to the driver, and as many at most come back. The result is cut.
    """
    spark, new = rows.sparkSession, [*sums, *xors]
    schema = T.StructType([*rows.schema, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), *[T.StructField(c, T.LongType()) for c in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held, state = TaskContext.get().partitionId(), 0, None, [0] * len(new)
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            keys = batch.column(key).to_numpy()
            fresh = np.append(keys[0] != held, keys[1:] != keys[:-1])
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            goes_on = start == 0 if not fresh[0] else np.zeros(n, dtype=bool)
            out = []
            for i, c in enumerate(sums.values()):
                v = batch.column(c).to_numpy()
                total = np.cumsum(v)
                out.append(total - total[start] + v[start] + np.where(goes_on, state[i], 0))
            for i, c in enumerate(xors.values(), len(sums)):
                v = batch.column(c).to_numpy()
                total = np.bitwise_xor.accumulate(v)
                out.append(total ^ total[start] ^ v[start] ^ np.where(goes_on, state[i], 0))
            held, state = keys[-1], [x[-1] for x in out]
            place = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *place, *map(pa.array, out)], [*batch.schema.names, "part", "at", *new])

    ranges = cut(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(run, schema))
    ends = ranges.groupBy("part").agg(F.min_by(key, "at").alias("first"), F.max_by(F.struct(F.col(key), *new), "at").alias("last"))
    carried, before = [], None
    for r in sorted(ends.collect()):
        last = list(r["last"])
        if before is not None and before[0] == r["first"]:
            carried.append((r["part"], *before))
            if last[0] == before[0]:
                last = [last[0], *[b + x if c in sums else b ^ x for c, b, x in zip(new, before[1:], last[1:], strict=True)]]
        before = last
    if not carried:
        return ranges.drop("part", "at")
    names = [f"_{c}" for c in new]
    more = F.broadcast(spark.createDataFrame(carried, ", ".join(["part int", "_key long", *[f"{c} long" for c in names]])))
    joined = ranges.join(more, (ranges["part"] == more["part"]) & (ranges[key] == more["_key"]), "left")
    zero = F.lit(0).cast("long")
    with_carried = {c: (F.col(c) + F.coalesce(f"_{c}", zero) if c in sums else F.col(c).bitwiseXOR(F.coalesce(f"_{c}", zero))) for c in new}
    return joined.select(*rows.columns, *[x.alias(c) for c, x in with_carried.items()])


def rebuilt(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, d1, d2, bytes) of the rebuilt conversations, and the conversations (conv_id) themselves.

    d1 and d2 are 128 bits that stand for role and text, which are read no further.
    """
    role, text = whole("role"), whole("text")
    digest = [F.xxhash64(F.lit(i), role, text).alias(f"d{i}") for i in (1, 2)]
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *digest, F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    numbered = running(turns, "conv_id", ["turn", "d1", "d2"], {"pos": "one"}, {}).drop("one", "turn")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    head = F.sort_array(F.collect_list(F.struct("pos", "d1", "d2", "bytes")))
    donors = numbered.filter((F.col("pos") < heads) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("donor")).agg(head.alias("head"))
    own = numbered.filter("pos = 1").select("conv_id", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("donor"))
    begun = F.coalesce(F.filter("head", lambda x: x["pos"] <= F.col("h")), F.array().cast(donors.schema["head"].dataType))
    convs = cut(own.join(donors, "donor", "left").select("conv_id", "h", begun.alias("head")))
    places = convs.select("conv_id", (F.size("head") - F.col("h")).alias("moved"))
    rest = numbered.filter(F.col("pos") > taken).join(places, "conv_id").select("conv_id", (F.col("pos") + F.col("moved")).alias("pos"), "d1", "d2", "bytes")
    return rest.unionByName(convs.select("conv_id", F.inline("head"))), convs.select("conv_id")


def end_digests(ends: DataFrame) -> DataFrame:
    """``ends(k1, k2, conv_id)`` -> k1, k2 and the SHA-256 of each group's ids in order, comma-joined.

    Ids are sorted by ranges of (group, id) and written out there, a row for a group and batch; these rows meet by
    group, in order, and go through the digest one after another: a group of any size takes a batch of memory.
    """

    def write_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k1, k2, ids = (b[c].to_numpy() for c in ("k1", "k2", "conv_id"))
            start = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
            written = [",".join(map(str, x.tolist())) for x in np.split(ids, start[1:])]
            yield pd.DataFrame({"k1": k1[start], "k2": k2[start], "first": ids[start], "ids": written})

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for b in batches:
            out = []
            for k1, k2, ids in zip(b["k1"].tolist(), b["k2"].tolist(), b["ids"], strict=True):
                if (k1, k2) == held:
                    state.update(f",{ids}".encode())
                    continue
                if held is not None:
                    out.append((*held, state.hexdigest()))
                held, state = (k1, k2), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if held is not None:
            yield pd.DataFrame([(*held, state.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    order = ["k1", "k2", "conv_id"]
    written = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(write_out, "k1 long, k2 long, first long, ids string")
    return written.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInPandas(digest, "k1 long, k2 long, ends_sha256 string")


def peeled_at_once(waiting: DataFrame) -> DataFrame:
    """The few chains that still wait, finished by one task in the same way: those without open children first."""

    def peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        names = list(zip(rows["conv_id"].tolist(), rows["n_convs"].tolist(), strict=True))
        at = {name: i for i, name in enumerate(names)}
        up = [at.get(p) for p in zip(rows["parent_conv_id"].tolist(), rows["parent_n"].tolist(), strict=True)]
        remaining, leaves, below, own = (rows[c].tolist() for c in ("remaining", "leaves", "below", "own"))
        done = [i for i, n in enumerate(remaining) if not n]
        for i in done:
            if (p := up[i]) is not None:
                remaining[p] -= 1
                leaves[p] += leaves[i]
                below[p] += below[i] + own[i]
                if not remaining[p]:
                    done.append(p)
        yield rows.assign(remaining=remaining, leaves=leaves, below=below)

    return waiting.coalesce(1).mapInPandas(peel, waiting.schema)


def peel_leaves(chains: DataFrame, at_once: int = PART_ROWS) -> DataFrame:
    """``chains(conv_id, n_convs, parent_conv_id, parent_n, children, own, ...)`` with leaves and below.

    leaves: leaves under a chain; below: what is saved under it. Every round the chains whose children are all done send their
    totals to their parents (a groupBy with partial sums, so a parent of very many children is no hot key), where
    each message lowers the number of those that remain; the rounds end when the root is done. Chains have fewer members than
    their parents, so the rounds are as many as the tree of chains is high; when no more than ``at_once`` chains wait,
    one task goes through their rounds.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    leaf = F.col("children") == 0
    state, n = counted_cut(chains.select("*", F.col("children").alias("remaining"), F.when(leaf, one).otherwise(zero).alias("leaves"), zero.alias("below")), ~leaf, None)
    columns, finished = state.columns, [state.filter("remaining = 0")]
    while n:
        sums = [F.count(F.lit(1)).alias("_done"), F.sum("leaves").alias("_leaves"), F.sum(F.col("below") + F.col("own")).alias("_below")]
        messages = finished[-1].groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("parent_n").alias("n_convs")).agg(*sums)
        told = {"remaining": F.col("remaining") - F.coalesce("_done", zero), "leaves": F.col("leaves") + F.coalesce("_leaves", zero), "below": F.col("below") + F.coalesce("_below", zero)}
        updated = state.filter("remaining > 0").join(messages, ["conv_id", "n_convs"], "left").select(*[told.get(c, F.col(c)).alias(c) for c in columns])
        if n <= at_once:
            updated = peeled_at_once(updated)
        state, n = counted_cut(updated, F.col("remaining") > 0, None)
        finished.append(state.filter("remaining = 0"))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, at_once: int = PART_ROWS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are in the order of ``turn``, null first; of turns alike in it a hash of role and text decides, and rows that are
    alike in all are as many turns. Null roles and texts are empty. Rows without conv_id belong to no conversation.
    Ids that are negative leave negative remainders. A table without conversations has no root and gives no rows.
    """
    turns, convs = rebuilt(conversations, family, heads)
    spark = turns.sparkSession
    element = [F.xxhash64(F.lit(i), "pos", "d1", "d2").alias(f"x{i}") for i in (3, 4)]
    path = running(turns.select("conv_id", "pos", *element, "bytes"), "conv_id", ["pos"], {"upto": "bytes"}, {"k1": "x3", "k2": "x4"})
    least, total = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    same = lambda x: F.any_value(x)  # noqa: E731  alike in all members
    shared = path.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), same(F.col("k1").bitwiseXOR(F.col("x3"))).alias("p1"), same(F.col("k2").bitwiseXOR(F.col("x4"))).alias("p2"),
        same("pos").alias("depth"), same("bytes").alias("bytes"), same("upto").alias("upto"),
    )
    nodes = cut(shared)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    columns = ["conv_id", "n_convs", "depth", "bytes", "upto", "k1", "k2", "parent_conv_id", "parent_n"]
    deeper = nodes.filter("depth > 1").join(parents, ["p1", "p2"]).select(*columns)
    first = nodes.filter("depth = 1").select(*columns[:-2], F.lit(least).cast("long").alias("parent_conv_id"), F.lit(total).cast("long").alias("parent_n"))
    root = spark.createDataFrame([(least, total, 0, 0, 0, 0, 0, 0, 0)] if total else [], ", ".join(f"{c} long" for c in columns))  # no chain has 0 members
    linked = cut(deeper.unionByName(first).unionByName(root))
    chains = linked.groupBy("conv_id", "n_convs").agg(F.min_by(F.struct("parent_conv_id", "parent_n"), "depth").alias("parent"), F.max("depth").alias("bottom"), F.max("upto").alias("bottom_upto"), F.min(F.col("upto") - F.col("bytes")).alias("top_upto"))
    chains = cut(chains.select("conv_id", "n_convs", "parent.*", "bottom", "bottom_upto", ((F.col("n_convs") - 1) * (F.col("bottom_upto") - F.col("top_upto"))).alias("own")))
    children = chains.groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("parent_n").alias("n_convs")).agg(F.count(F.lit(1)).alias("children"))
    counted = chains.join(children, ["conv_id", "n_convs"], "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))
    totals = peel_leaves(counted, at_once).select("conv_id", "n_convs", "bottom", "bottom_upto", "children", "leaves", "below")
    last = path.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2"), "pos").alias("end"))
    zero = F.lit(0).cast("long")
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("end.k1", zero).alias("k1"), F.coalesce("end.k2", zero).alias("k2"))
    to_bottom = F.col("bottom_upto") - F.col("upto") + F.col("bytes")
    return linked.join(totals, ["conv_id", "n_convs"]).join(end_digests(ends), ["k1", "k2"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") == F.col("bottom"), F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n_convs") - 1) * to_bottom).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op11(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations)


#: CRC-32 of a decimal id, bit by bit: the engine of this SQL has no function for it.
CRC32 = """xor(list_reduce(range(8 * len(conv_id::VARCHAR)), lambda crc, i: CASE
    WHEN (CASE WHEN i % 8 = 0 THEN xor(crc, ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::BIGINT, 1))::BIGINT) ELSE crc END) % 2 = 1
    THEN xor((CASE WHEN i % 8 = 0 THEN xor(crc, ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::BIGINT, 1))::BIGINT) ELSE crc END) // 2, 3988292384)
    ELSE (CASE WHEN i % 8 = 0 THEN xor(crc, ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::BIGINT, 1))::BIGINT) ELSE crc END) // 2 END, 4294967295), 4294967295)"""
SQL = f"""
WITH turns AS (
  SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS donor, {CRC32} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM turns)
), placed AS (
  SELECT c.conv_id, 0 AS half, t.pos, t.turn_id, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.donor WHERE t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1 AS half, t.pos, t.turn_id, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.pos > c.h
), ranked AS (
  SELECT conv_id, turn_id, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY half, pos) AS depth FROM placed
), paths AS (
  SELECT conv_id, depth, bytes, md5(string_agg(turn_id, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS node FROM ranked
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), steps AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM paths
), nodes AS (
  SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM steps GROUP BY node
), children AS (
  SELECT parent, count(*)::BIGINT AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.parent = n.node
), below AS (
  SELECT s.node, sum(CASE WHEN n.conv_id = s.conv_id THEN n.own ELSE 0 END) OVER later AS saved,
    sum(CASE WHEN n.conv_id = s.conv_id AND n.n_children = 0 THEN 1 ELSE 0 END) OVER later AS leaves
  FROM steps s JOIN counted n USING (node) WINDOW later AS (PARTITION BY s.conv_id ORDER BY s.depth DESC ROWS UNBOUNDED PRECEDING)
), summed AS (
  SELECT node, sum(saved)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM below GROUP BY node
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM counted JOIN summed USING (node)
"""
