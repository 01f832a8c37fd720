"""Mixing sources to target weights: repetition rates per source, seeded copies per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import cut, if_small, n_words, whole

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 42


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of ``sized(source, size)``: source, source_size, weight, target.

    The targets share the sum of all sizes by weight. A target stops at ``max_repeats`` times its source's
    size and the excess is shared by weight again until none is above. Sorted by size over weight, the
    capped sources are a prefix, so running sums give the fixed point in one pass. The table has one row per
    source, aggregated before anything is ordered; null is a source of its own and comes last.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = (
        per_source.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeats)
    )
    zero = F.lit(0).cast("long")
    summed = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(before), zero).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), zero).alias("weight_before"),
    ).withColumn("capped", (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")) * F.col("weight") > F.col("cap"))
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(zero)).over(everything)
    gone = F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(zero)).over(everything)
    level = (F.col("total") - spent) / (F.col("weights") - gone)
    return summed.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


#: Equal rows that one step lists, at most.
EQUAL_ROWS = 1 << 16


def seeded_uniform(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that only the key and the seed decide: 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def draw_key(doc_id: str = "doc_id", digest: str = "digest", rank: str = "rank") -> Column:
    """What a row's draw follows from: its id, its text, and its number among the rows of its source alike in both."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), digest, F.col(rank).cast("string"))


def repeats(rows: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows(source, size, doc_id, digest, rank, ...)`` with source_size, target and copies.

    copies is floor(rate) plus one Bernoulli copy of the rate's fraction, with rate = target / source_size.
    ``targets`` has a row per source: it is counted, and broadcast if it is small; beyond that both sides are
    shuffled and a hot source's partition is split.
    """
    t = if_small(cut(targets)).select(F.col("source").alias("_source"), F.col("source_size"), F.col("target"))
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (seeded_uniform(draw_key(), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate) + extra)


def digest_of(text_col: str) -> Column:
    return F.md5(whole(text_col).cast("binary"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows alike in doc_id, source and text once, with size (number of words), digest and n (how many they are)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), digest_of(text_col).alias("digest"))
    return cut(rows.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("n")))


def numbered(sized: DataFrame) -> DataFrame:
    """The rows of measured() one by one again, each with its rank among those that are alike.

    They are counted before the shuffle and listed after it, in steps, so that a row that is repeated very often
    is no hot key.
    """
    steps = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EQUAL_ROWS))).alias("step"))
    first, last = F.col("step") * EQUAL_ROWS + 1, F.least(F.col("n"), (F.col("step") + 1) * EQUAL_ROWS)
    return steps.select("doc_id", "source", "size", "digest", F.explode(F.sequence(first, last)).alias("rank"))


def targets_of(sized: DataFrame, **settings) -> DataFrame:
    return source_targets(sized.select("source", (F.col("size") * F.col("n")).alias("size")), **settings)


def mixing_plan(docs: DataFrame, **columns: str) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    A null text has size 0; a source of size 0 has target 0 and takes nothing. Rows that share their id, or have none,
    are drawn apart, by their texts and then one by one; an empty table gives an empty plan.
    """
    sized = measured(docs, **columns)
    return repeats(numbered(sized), targets_of(sized)).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as many times as its plan says, same columns.

    Other columns may have any name: a row travels as one struct. Only rows that are alike in id, source and text are
    shuffled, to be numbered.
    """
    sized = measured(docs, id_col, text_col, source_col)
    key = ["doc_id", "source", "digest"]
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest"))
    again = cut(sized.filter("n > 1").select(*[F.col(c).alias(f"_{c}") for c in key]))
    if again.isEmpty():
        ranked = rows.withColumn("rank", F.lit(1).cast("long"))
    else:
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
        more, once = (rows.join(if_small(again), same, how) for how in ("left_semi", "left_anti"))
        by = Window.partitionBy(*key).orderBy(F.xxhash64(F.to_json("row")))
        ranked = once.withColumn("rank", F.lit(1).cast("long")).unionByName(more.withColumn("rank", F.row_number().over(by).cast("long")))
    counted = repeats(ranked, targets_of(sized))
    return counted.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op7(docs: DataFrame) -> DataFrame:
    return mixing_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '') ORDER BY doc_id) AS n, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM per_source
), weighted AS (
  SELECT *, ((rank - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM ranked
), summed AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, (sum(weight) OVER ())::DOUBLE AS weights,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS cap_before,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS weight_before
  FROM weighted
), marked AS (
  SELECT *, (total - cap_before) / (weights - weight_before) * weight > cap AS capped FROM summed
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE,
    (total - (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE) / (weights - (sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ())::DOUBLE) * weight) AS target
  FROM marked
), rated AS (
  SELECT s.doc_id, s.digest, s.n, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || n), 1, 13))::BIGINT / {float(1 << 52)!r} < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""
