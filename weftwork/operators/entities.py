"""Entity candidates from chunks, by a pluggable extractor, and their normalisation against the documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import acronym, any_of, casefold, context_window, entity_key, first_filled, normalize_term, page_tail, singular_key
from weftwork.storage import joinable, materialized
from weftwork.vocab import GENERIC_SUFFIXES, Vocabulary

MAX_TEXT_CHARS = 3500
RAW = "text string, label string, score double, start int, end int"
TRIM = " \t\r\n.,;:()[]{}"


class EntityExtractor(Protocol):
    """What an extraction backend offers; one is made in each Python worker."""

    backend: str
    source_model: str

    def extract(self, text: str, labels: list[str]) -> list[dict]: ...


class DictionaryExtractor:
    """A backend without a model: known names, each with its label, wherever they stand alone."""

    backend, source_model = "dictionary", "names"

    def __init__(self, names: dict[str, str], score: float = 1.0, threshold: float = 0.0):
        if score < threshold:  # nothing that it finds scores high enough
            names = {}
        self.names, self.score = {k.lower(): v for k, v in names.items()}, score
        longest_first = sorted(self.names, key=lambda n: (-len(n), n))
        self.pattern = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, longest_first))})(?!\w)", re.IGNORECASE) if names else None

    def extract(self, text: str, labels: list[str]) -> list[dict]:
        found = self.pattern.finditer(text) if self.pattern else ()
        rows = ((m, self.names[m[0].lower()]) for m in found)
        return [{"text": m[0], "label": label, "score": self.score, "start": m.start(), "end": m.end()} for m, label in rows if label in labels]


BACKENDS: dict[str, Callable[..., EntityExtractor]] = {"dictionary": DictionaryExtractor}


def create_extractor(backend: str, **options) -> EntityExtractor:
    if backend not in BACKENDS:
        raise ValueError(f"unknown extraction backend: {backend}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[backend](**options)


def labels_for_profile(profile: str, vocab: Vocabulary = Vocabulary()) -> list[str]:  # noqa: B008
    if profile not in vocab.label_profiles:
        raise ValueError(f"unknown label profile: {profile}; known: {', '.join(sorted(vocab.label_profiles))}")
    return list(vocab.label_profiles[profile])


def chunk_labels(labels: list[str], vocab: Vocabulary, scoped: bool) -> Column:
    """Labels to ask for in a chunk: all, or the first rule's that its id and path fit and those always asked for."""
    every = F.array(*[F.lit(x) for x in labels])
    if not scoped or not vocab.label_rules:
        return every
    place = casefold(F.concat_ws(" ", "document_id", "file_path"))
    matched = F.coalesce(*[F.when(any_of([F.contains(place, F.lit(p)) for p in patterns]), F.lit(label)) for patterns, label in vocab.label_rules])
    return F.when(matched.isNotNull(), F.array_distinct(F.concat(F.array(matched), F.array(*[F.lit(x) for x in vocab.always_labels])))).otherwise(every)


def select_chunks(chunks: DataFrame, limit: int | None, sampling: str = "balanced") -> DataFrame:
    """The first chunks in order, or one of each document in turn. ``chunks`` have document_id, ordinal (of all chunks)."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be above zero")
    if sampling not in ("balanced", "sequential"):
        raise ValueError("sampling must be balanced or sequential")
    if limit is None:
        return chunks
    if sampling == "sequential":
        return chunks.orderBy("ordinal").limit(limit)
    own = Window.partitionBy("document_id")
    turns = chunks.withColumn("_turn", F.row_number().over(own.orderBy("ordinal"))).withColumn("_first", F.min("ordinal").over(own))
    return turns.orderBy("_turn", "_first").limit(limit).drop("_turn", "_first")


def candidate_text(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(TRIM))


def useful_candidate(c: Column, vocab: Vocabulary) -> Column:
    key = casefold(c)
    suffix = any_of([key.endswith(s) for s in GENERIC_SUFFIXES])
    return F.length(c).between(2, 100) & ~key.isin("wiki", "article", "page", "game", "player", "players", *vocab.generic_terms) & ~(suffix & ~key.rlike("^(?:news|wiki)")) & c.rlike("[A-Za-z0-9!]")


def extract_entities(chunks: DataFrame, backend: str, options: dict, labels: list[str], vocab: Vocabulary = Vocabulary(), scoped: bool = False, max_text_chars: int = MAX_TEXT_CHARS) -> DataFrame:  # noqa: B008
    """Useful mentions in chunks, the best of each (name, label, document).

    The backend sees Arrow batches of whole partitions; ``max_text_chars`` is the model's window. ``ord`` is
    the place in input order, which breaks ties.
    """
    asked = chunks.select("chunk_id", "document_id", "source_type", "title", "heading_path", "ordinal", F.substring("text", 1, max_text_chars).alias("text"), chunk_labels(labels, vocab, scoped).alias("labels"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = create_extractor(backend, **options)
        for b in batches:
            found = [[(str(r.get("text") or ""), str(r.get("label") or ""), float(r.get("score") or 0), r.get("start"), r.get("end")) for r in extractor.extract(t, list(x))] for t, x in zip(b["text"], b["labels"], strict=True)]
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "found": found, "source_model": extractor.source_model})

    raw = asked.select("chunk_id", "text", "labels").mapInPandas(run, f"chunk_id string, found array<struct<{RAW.replace(' ', ':').replace(',:', ',')}>>, source_model string")
    mentions = raw.select("chunk_id", "source_model", F.posexplode("found").alias("at", "m")).join(asked.drop("labels"), "chunk_id")
    name = candidate_text(F.col("m.text"))
    rows = mentions.select(
        name.alias("text"), F.trim(F.col("m.label")).alias("label"), candidate_text(F.translate(name, "_-", "  ")).alias("canonical_guess"), F.col("m.score").alias("score"), "chunk_id", "document_id",
        "source_type", "title", "heading_path", F.col("m.start").alias("start"), F.col("m.end").alias("end"), context_window(F.col("text"), F.col("m.start"), F.col("m.end")).alias("context"),
        F.lit(backend).alias("backend"), "source_model", F.struct("ordinal", "at").alias("ord"),
    ).filter((F.col("label") != "") & useful_candidate(F.col("text"), vocab))
    return best_candidates(rows)


def best_candidates(rows: DataFrame) -> DataFrame:
    """The best score of each (canonical_guess, label, document_id), the first of equals."""
    best = Window.partitionBy(casefold(F.col("canonical_guess")), casefold(F.col("label")), "document_id").orderBy(F.desc("score"), "ord")
    return rows.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank")


def document_index(docs: DataFrame) -> DataFrame:
    """key, page_id, title, ordinal: a row for each key under which a page may be named."""
    page = F.col("page_id")
    rows = docs.filter(F.coalesce(page, F.lit("")) != "").select("page_id", first_filled(F.col("title"), page_tail(page)).alias("title"), "ordinal")
    title = canonical_text(F.col("title"))
    tail = F.replace(F.regexp_extract(page, "([^/]*)$", 1), F.lit("_"), F.lit(" "))
    rows = rows.withColumn("_canonical", title)
    rows = rows.withColumn("_title", entity_key(F.col("_canonical"))).withColumn("_tail", entity_key(tail))  # each once a page
    keys = F.array_compact(F.array(F.col("_title"), singular_key(F.col("_title")), F.col("_tail"), singular_key(F.col("_tail")), entity_key(F.replace(page, F.lit("/"), F.lit(" "))), entity_key(acronym(F.col("_canonical")))))
    return rows.select(F.explode(F.array_distinct(F.filter(keys, lambda k: k != ""))).alias("key"), "page_id", "title", "ordinal")


def canonical_text(c: Column) -> Column:
    """A term with its first letter in capitals, if it has only small ones."""
    term = normalize_term(c)
    small = (term == F.lower(term)) & term.rlike(r"\p{Ll}")
    return F.when(small, F.concat(F.upper(F.substring(term, 1, 1)), F.substring(term, F.lit(2), F.length(term)))).otherwise(term)


def resolve_targets(rows: DataFrame, index: DataFrame, vocab: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """``rows(name, document_id, ...)`` with target_page_id, target_title and link_reason.

    The first rule that gives a page wins: a manual alias, the source's own title, the key, its singular (one
    page; of several the source's own, else the first), the source's path tail. Each rule is a left join on
    keys that are unique, so no row multiplies; of the keys' pages only those of keys that rows have are counted.
    Sides of joins are counted before any is broadcast.
    """
    spark = rows.sparkSession
    index = materialized(index)
    pages = joinable(index.groupBy("page_id").agg(F.min_by("title", "ordinal").alias("title")))
    out = rows.withColumn("_key", entity_key(F.col("name")))
    out = materialized(out.withColumn("_single", singular_key(F.col("_key"))))
    wanted = joinable(out.select(F.explode(F.array("_key", "_single")).alias("key")).distinct())
    asked = index.join(wanted, "key", "left_semi")
    by_key = joinable(asked.groupBy("key").agg(F.count_distinct("page_id").alias("n"), F.min_by("page_id", "ordinal").alias("first_page")))
    own_keys = joinable(asked.select("key", F.col("page_id").alias("own_page")).distinct())
    own = pages.select(F.col("page_id").alias("document_id"), F.col("title").alias("_own_title"))
    out = out.join(own, "document_id", "left")
    manual = [F.struct(F.lit(k).alias("_key"), F.lit(v).alias("_manual")) for k, v in vocab.manual_targets.items()]
    if manual:
        given = spark.range(1).select(F.inline(F.array(*manual))).join(pages.select(F.col("page_id").alias("_manual")), "_manual", "left_semi")
        out = out.join(F.broadcast(given), "_key", "left")
    else:
        out = out.withColumn("_manual", F.lit(None).cast("string"))
    for name in ("_key", "_single"):
        out = out.join(by_key.select(F.col("key").alias(name), F.col("n").alias(f"n{name}"), F.col("first_page").alias(f"first{name}")), name, "left")
        out = out.join(own_keys.select(F.col("key").alias(name), F.col("own_page").alias("document_id"), F.lit(True).alias(f"own{name}")), [name, "document_id"], "left")
    title_key = entity_key(F.coalesce("_own_title", F.lit("")))
    has_own = F.col("_own_title").isNotNull()
    tail_key = entity_key(F.regexp_extract("document_id", "([^/]*)$", 1))
    link = lambda page, reason: F.struct(page.alias("page"), F.lit(reason).alias("reason"))
    rule = F.when(F.col("_manual").isNotNull(), link(F.col("_manual"), "manual_alias")).when(has_own & ((F.col("_key") == title_key) | (F.col("_single") == singular_key(title_key))), link(F.col("document_id"), "source_title"))
    for name in ("_key", "_single"):
        rule = rule.when(F.col(f"n{name}") == 1, link(F.col(f"first{name}"), "global_title")).when(F.col(f"own{name}"), link(F.col("document_id"), "ambiguous_source_title")).when(F.col(f"n{name}") > 1, link(F.col(f"first{name}"), "ambiguous_global_title"))
    rule = rule.when(has_own & F.col("_key").isin(tail_key, singular_key(title_key)), link(F.col("document_id"), "source_path_tail")).otherwise(link(F.lit("").cast("string"), "unlinked"))
    out = out.withColumn("_rule", rule).withColumn("target_page_id", F.col("_rule.page")).withColumn("link_reason", F.col("_rule.reason"))
    out = out.join(pages.select(F.col("page_id").alias("target_page_id"), F.col("title").alias("target_title")), "target_page_id", "left")
    return out.select(*rows.columns, "target_page_id", F.coalesce("target_title", F.lit("")).alias("target_title"), "link_reason")


def normalize_candidates(candidates: DataFrame, index: DataFrame, vocab: Vocabulary = Vocabulary(), full_merge: bool = False) -> DataFrame:  # noqa: B008
    """Candidates grouped by name, label and target (or source, if unlinked), each with its decision.

    ``candidates``: text, label, score, document_id, chunk_id, context, ord. The row of the highest confidence
    stands for a group, the first of equals. By default only rows that come after it add their aliases,
    mentions and sources; with ``full_merge`` all do.
    """
    rows = candidates.select(normalize_term(F.col("text")).alias("name"), "label", F.coalesce("document_id", F.lit("")).alias("document_id"), F.round(F.coalesce("score", F.lit(0.0)), 3).alias("confidence"), F.coalesce("score", F.lit(0.0)).alias("score"), "chunk_id", F.coalesce("context", F.lit("")).alias("context"), "ord")
    linked = resolve_targets(rows, index, vocab)
    has = F.col("target_page_id") != ""
    canonical = F.when(has, F.col("target_title")).otherwise(canonical_text(F.col("name")))
    reject = entity_key(F.col("name")).isin(*vocab.generic_terms) if vocab.generic_terms else F.lit(False)
    decision = F.when(reject, "reject").when(has & (F.col("score") >= 0.7), "accept").otherwise("review")
    reason = (
        F.when(reject, "generic_domain_word")
        .when(has & (F.col("score") >= 0.7), F.concat(F.lit("linked_"), F.col("link_reason")))
        .when(has, F.concat(F.lit("linked_"), F.col("link_reason"), F.lit("_low_confidence")))
        .when((F.col("score") >= 0.75) & (F.length("name") >= 4), "high_confidence_unlinked")
        .otherwise("unlinked_low_confidence")
    )
    judged = linked.withColumn("canonical", canonical).withColumn("canonical_key", entity_key(canonical)).withColumn("decision", decision).withColumn("decision_reason", reason)
    judged = judged.withColumn("group_id", F.when(has, F.col("target_page_id")).otherwise(F.col("document_id"))).withColumn("own_aliases", F.filter(F.array("name", canonical_text(F.col("name")), canonical), lambda a: a != ""))
    keys = ["canonical_key", "label", "group_id"]
    return merge_after_winner(judged, keys, full_merge)


def merge_after_winner(rows: DataFrame, keys: list[str], full_merge: bool = False) -> DataFrame:
    """One row per group: the winner's columns, and aliases, mentions and sources of it and of the rows after it."""
    best = rows.groupBy(*keys).agg(F.max("confidence").alias("best"))
    first = rows.join(best, keys).filter(F.col("confidence") == F.col("best")).groupBy(*keys).agg(F.min("ord").alias("win_ord"))
    top = rows.join(first, keys)
    used = top if full_merge else top.filter(F.col("ord") >= F.col("win_ord"))
    by_name = lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    merged = used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mentions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("own_aliases"))), by_name).alias("aliases"),
        F.array_sort(F.filter(F.collect_set("document_id"), lambda d: d != ""), by_name).alias("source_document_ids"),
    )
    head = top.filter(F.col("ord") == F.col("win_ord")).select(*keys, "canonical", "decision", "decision_reason", "confidence", "target_page_id", "target_title", "link_reason", F.col("document_id").alias("source_document_id"), F.col("chunk_id").alias("source_chunk_id"), F.col("name").alias("example_text"), F.col("context").alias("example_context"))
    return head.join(merged, keys).drop("group_id")


def normalization_report(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("normalized_rows"),
        F.count_if(F.col("target_page_id") != "").alias("linked_rows"),
        F.count_distinct(F.when(F.col("decision") != "reject", F.col("canonical"))).alias("unique_canonical_entities"),
    )


def normalization_review_rows(rows: DataFrame) -> DataFrame:
    """Flat rows for a CSV file."""
    return rows.select("decision", "decision_reason", "confidence", "canonical", F.array_join("aliases", " | ").alias("aliases"), "label", "target_page_id", "source_document_id", "mentions", "example_context")


def candidate_report(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_distinct(casefold(F.col("canonical_guess")), "label").alias("unique_entity_label_pairs"),
        F.count_distinct("document_id").alias("documents_with_candidates"),
    )
