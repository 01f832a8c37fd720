"""Terms: canonical names with their aliases and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import acronym, blank, brand_variants, casefold, links_to_target, normalize_term, plural_alias, useful_term
from weftwork.storage import materialized
from weftwork.vocab import Vocabulary

LAYOUT_PARTS = ("database", "wiki", "news", "en.md")
MAX_SOURCES = 20


def add_terms(named: DataFrame, brand: str = "") -> DataFrame:
    """``named(raw, source, hint)`` as (canonical, alias, source): the alias, its spellings, its plural and its acronym.

    What is named more than once is one row before its spellings are made.
    """
    named = named.select("raw", "source", "hint").distinct()
    alias = normalize_term(F.col("raw"))
    rows = named.select(alias.alias("alias"), F.coalesce(F.nullif(normalize_term(F.col("hint")), F.lit("")), alias).alias("canonical"), "source").filter("alias <> '' and canonical <> ''")
    every = F.array_compact(F.concat(F.array("alias", plural_alias(F.col("alias")), acronym(F.col("alias"))), brand_variants(F.col("alias"), brand)))
    return rows.select("canonical", F.explode(F.array_distinct(every)).alias("alias"), "source")


def merge_terms(aliases: DataFrame) -> DataFrame:
    """canonical, aliases, sources, score: terms that differ in case are one, shown by the smallest spelling.

    Aliases and sources are made distinct per key before they are collected. Useless aliases go, and terms
    whose name is useless or that keep no alias.
    """
    keyed = materialized(aliases.withColumn("key", casefold(F.col("canonical"))))  # read three times
    names = keyed.groupBy("key").agg(F.min("canonical").alias("canonical"))
    spelled = keyed.select("key", "alias").union(keyed.select("key", F.col("canonical").alias("alias"))).distinct().filter(useful_term(F.col("alias")))
    by_name = lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    sets = spelled.groupBy("key").agg(F.array_sort(F.collect_list("alias"), by_name).alias("aliases"))
    sources = keyed.select("key", "source").distinct().groupBy("key").agg(F.slice(F.array_sort(F.collect_list("source")), 1, MAX_SOURCES).alias("sources"))
    merged = names.filter(useful_term(F.col("canonical"))).join(sets, "key").join(sources, "key")
    return merged.select("canonical", "aliases", "sources", F.least(F.lit(4.0), F.lit(1.0) + F.size("aliases") / 10).alias("score"))


def named_of(docs: DataFrame) -> DataFrame:
    """raw, source, hint of all that names something in a document: title, ids, headings, tags, path parts, link targets and fitting link texts."""
    path = F.coalesce(*[F.when(~blank(F.col(c)), F.col(c)) for c in ("repo_rel_path", "page_id", "post_id") if c in docs.columns], F.lit(""))
    have = [c for c in ("title", "page_id", "post_id", "topic", "domain", "subculture", "slug") if c in docs.columns]
    empty = F.array().cast("array<string>")
    lists = lambda c: F.coalesce(F.col(c), empty) if c in docs.columns else empty
    headings = F.flatten(F.transform("sections", lambda s: F.concat(F.array(s["title"]), F.coalesce(s["heading_path"], empty))))
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin(*LAYOUT_PARTS))
    own = F.concat(F.array(*have), F.coalesce(headings, empty), lists("tags"), lists("series_tags"), parts)
    plain = docs.select(F.explode(F.filter(own, lambda v: ~blank(v))).alias("raw"), path.alias("source"))
    edges = docs.select(path.alias("source"), F.explode("link_edges").alias("e")).filter(~blank(F.col("e.target_page_id"))).select("source", F.col("e.link_text").alias("text"), F.regexp_extract("e.target_page_id", "([^/]*)$", 1).alias("target"))
    fits = edges.filter(links_to_target(F.col("text"), F.col("target"))).select(F.col("text").alias("raw"), "source", F.col("target").alias("hint"))
    targets = edges.select(F.col("target").alias("raw"), "source", F.col("target").alias("hint"))
    return plain.select("raw", "source", F.col("raw").alias("hint")).unionByName(fits).unionByName(targets)


def build_terms(docs: DataFrame, vocab: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    named = named_of(docs)
    if vocab.seed_terms:
        seeds = docs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in vocab.seed_terms])).alias("raw"))
        named = named.unionByName(seeds.select("raw", F.lit("common").alias("source"), F.col("raw").alias("hint")))
    return merge_terms(add_terms(named, vocab.brand))


def terms_report(terms: DataFrame) -> DataFrame:
    return terms.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum(F.size("aliases")), F.lit(0)).alias("aliases"))


