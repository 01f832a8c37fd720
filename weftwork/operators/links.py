"""Link tables: occurrences from documents' edges, alias candidates with decisions, review rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import anchor_text, blank, page_tail, target_page, term_key
from weftwork.vocab import DECISIONS, GENERIC_ANCHORS


def link_rows(docs: DataFrame) -> DataFrame:
    """One row per link edge, with normalised text and target; documents without edges have none.

    ``ord`` is the place in document order: (document's ordinal, edge's place), which breaks ties.
    """
    made = docs.select("source", "document_id", "title", "repo_rel_path", F.col("ordinal") if "ordinal" in docs.columns else F.col("document_id").alias("ordinal"), F.posexplode("link_edges").alias("at", "edge"))
    text, target = anchor_text(F.col("edge.link_text")), target_page(F.col("edge.target_page_id"))
    internal = F.col("edge.link_type").isin("wiki_article", "wiki_section") & (target != "")
    return made.select(
        "source", F.col("document_id").alias("source_id"), F.col("title").alias("source_title"), F.col("repo_rel_path").alias("source_path"),
        F.col("edge.source_section_id").alias("source_section_id"), F.col("edge.source_heading_path").alias("heading_path"),
        text.alias("link_text"), term_key(text).alias("link_text_key"), F.col("edge.url_raw").alias("url_raw"), F.col("edge.url_resolved").alias("url_resolved"),
        F.col("edge.link_type").alias("link_type"), target.alias("target_page_id"), F.col("edge.target_anchor").alias("target_anchor"),
        F.coalesce(F.col("edge.context"), F.lit("")).alias("context"), F.coalesce(internal, F.lit(False)).alias("is_internal"), F.struct("ordinal", "at").alias("ord"),
    )


def generic_anchor(text: Column) -> Column:
    key = term_key(text)
    return key.isin(*GENERIC_ANCHORS) | key.rlike(r"^(?:(?:read|see|learn) (?:this|more|here|article|page)|.{0,40}\bwiki page|\d{4})$")


def edition_anchor(text: Column, target: Column) -> Column:
    """A year-like text for a page of a tournament or contest."""
    key = term_key(text)
    return (target.startswith("Tournaments/") | target.startswith("Contests/")) & key.rlike(r"^\d{4}(?: (?:4k|7k))?$|\b(?:20\d{2}|19\d{2})\b")


def link_confidence(alias: Column, target: Column, target_count: Column, link_count: Column, source_count: Column, ambiguity: Column) -> Column:
    """Evidence in [0, 1]: counts, share of the target, fit of alias and target, less for ambiguous, generic, short and yearly ones."""
    key, tail, full = term_key(alias), term_key(page_tail(target)), term_key(F.translate(target, "/_", "  "))
    score = (
        F.lit(0.25)
        + F.least(F.lit(0.22), target_count / 25)
        + F.least(F.lit(0.18), source_count / 20)
        + F.lit(0.25) * (target_count / link_count)
        + F.when(key == tail, 0.25).when((key != "") & (F.contains(full, key) | F.contains(key, tail)), 0.12).otherwise(0.0)
        - F.when(ambiguity > 1, F.least(F.lit(0.35), F.lit(0.08) * (ambiguity - 1))).otherwise(0.0)
        - F.when(generic_anchor(alias), 0.6).otherwise(0.0)
        - F.when(F.length(key) < 3, 0.3).otherwise(0.0)
        - F.when(edition_anchor(alias, target), 0.25).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def link_decision(c: DataFrame) -> tuple[Column, Column]:
    """Decision and reason, from the confidence as it is before rounding."""
    alias, conf, amb = F.col("alias"), F.col("confidence"), F.col("ambiguous_target_count")
    generic, edition = generic_anchor(alias), edition_anchor(alias, F.col("target_page_id"))
    strong = (conf >= 0.78) & (amb <= 2) & ((F.col("source_count") >= 2) | (F.col("link_count") >= 4))
    decision = F.when(generic | (conf < 0.35), "reject").when(edition, "review").when(strong, "accept").otherwise("review")
    reason = (
        F.when(generic, "generic_anchor")
        .when(conf < 0.35, "low_confidence")
        .when(edition, "tournament_or_year_specific")
        .when(amb > 2, "ambiguous_targets")
        .when(strong, "repeated_high_confidence")
        .when((F.col("source_count") < 2) & (F.col("link_count") < 4), "weak_single_source_evidence")
        .when(amb > 1, "minor_target_ambiguity")
        .otherwise("needs_manual_confirmation")
    )
    return decision, reason


def known_pages(docs: DataFrame) -> DataFrame:
    return docs.filter((F.col("source") == "wiki") & ~blank(F.col("page_id"))).select(F.col("page_id").alias("target_page_id")).distinct()


def link_candidates(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per alias key of the internal links: its most frequent target and text (the first seen of equals), evidence and decision.

    News are no targets, nor are unknown pages if pages are known. Counts are taken by (key, target) and (key,
    text) before keys are put together, so a frequent alias moves as one row per target.
    """
    used = rows.filter(F.col("is_internal") & (F.col("link_text_key") != "") & ~F.col("target_page_id").startswith("news/"))
    if known is not None and not known.isEmpty():
        used = used.join(known, "target_page_id", "left_semi")
    key = "link_text_key"
    targets = used.groupBy(key, "target_page_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    ranked = targets.withColumn("rank", F.row_number().over(order))
    modal = ranked.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col("target_page_id"))).alias("target_page_id"),
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("target_count"),
        F.count(F.lit(1)).alias("ambiguous_target_count"),
        F.sum("n").alias("link_count"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").between(2, 6), F.struct("rank", "target_page_id", F.col("n").alias("count"))))), lambda t: F.struct(t["target_page_id"], t["count"])).alias("other_targets"),
    )
    texts = used.filter(~blank(F.col("link_text"))).groupBy(key, "link_text").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    shown = texts.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select(key, F.col("link_text").alias("alias"))
    sources = used.select(key, "source_id").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("source_count"))
    seen = used.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).filter("rank <= 5")
    examples = seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_id", "source_title", "heading_path", "context"))), lambda e: F.struct(e["source_id"], e["source_title"], e["heading_path"], e["context"])).alias("examples"))
    rated = modal.join(shown, key).join(sources, key).join(examples, key)
    rated = rated.withColumn("confidence", link_confidence(F.col("alias"), F.col("target_page_id"), F.col("target_count"), F.col("link_count"), F.col("source_count"), F.col("ambiguous_target_count")))
    decision, reason = link_decision(rated)
    return rated.select(
        "alias", F.col(key).alias("alias_key"), "target_page_id", page_tail(F.col("target_page_id")).alias("target_title_guess"), decision.alias("decision"), reason.alias("decision_reason"),
        "confidence", "source_count", "link_count", "target_count", "ambiguous_target_count", "other_targets", "examples",
    )


def decision_order(decision: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(d) for d in DECISIONS]), decision)
    return F.when(at > 0, at - 1).otherwise(9)


def in_review_order(candidates: DataFrame) -> DataFrame:
    """Accepted, to be reviewed, rejected; those to be reviewed by reason and evidence."""
    review = F.col("decision") == "review"
    return candidates.orderBy(
        decision_order(F.col("decision")), F.when(review, F.col("decision_reason")), F.when(review, -F.col("source_count")), F.when(review, -F.col("link_count")), -F.round("confidence", 3), "alias_key"
    )


def review_rows(candidates: DataFrame) -> DataFrame:
    """Flat rows for a CSV file; write with ``partitionBy("decision")`` for a file per decision."""
    context = F.get(F.filter(F.transform("examples", lambda e: F.trim(e["context"])), lambda c: c != ""), F.lit(0))
    others = F.array_join(F.transform("other_targets", lambda t: F.concat(t["target_page_id"], F.lit(" ("), t["count"].cast("string"), F.lit(")"))), "; ")
    return candidates.select(
        "decision", "decision_reason", F.round("confidence", 3).alias("confidence"), "alias", "target_page_id", "target_title_guess", "source_count", "link_count", "ambiguous_target_count",
        others.alias("other_targets"), F.coalesce(context, F.lit("")).alias("example_context"),
    )


def link_report(rows: DataFrame, candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """One row of counts."""
    of = lambda d: F.count_if(F.col("decision") == d)
    links = rows.agg(F.count(F.lit(1)).alias("raw_links"), F.count_if("is_internal").alias("internal_links"))
    decided = candidates.agg(F.count(F.lit(1)).alias("candidate_aliases"), of("accept").alias("accepted"), of("review").alias("review"), of("reject").alias("rejected"))
    return docs.agg(F.count(F.lit(1)).alias("documents")).crossJoin(links).crossJoin(decided)


def top_link_types(rows: DataFrame, limit: int = 20) -> DataFrame:
    return rows.groupBy("link_type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").limit(limit).select("link_type", "n")
