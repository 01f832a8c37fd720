"""Corpus statistics and validation: one scan per table, all histograms and all rules together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import blank, casefold
from weftwork.vocab import VALIDATOR_STOPWORDS

LARGE_CHUNK, MANY_CHUNKS, MANY_EMPTY, MANY_ALIASES = 9000, 500, 20, 40


def histograms(rows: DataFrame, columns: dict[str, Column], ordinal: Column | None = None) -> DataFrame:
    """name, value, n for several columns in one pass: a GROUPING SETS aggregation; null and empty values count as unknown."""
    shown = rows.select(*[F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown")).alias(name) for name, c in columns.items()], (F.lit(0) if ordinal is None else ordinal).alias("_ord"))
    names = list(columns)
    sets = shown.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_set"), F.min("_ord").alias("first"))
    bit = {name: (1 << len(names)) - 1 - (1 << (len(names) - 1 - i)) for i, name in enumerate(names)}
    name = reduce(lambda other, k: F.when(F.col("_set") == bit[k], k).otherwise(other), names, F.lit(None).cast("string"))
    return sets.select(name.alias("name"), F.coalesce(*[F.col(n) for n in names]).alias("value"), "n", "first")


def top_values(hist: DataFrame, limit: int) -> DataFrame:
    """The most frequent values of each name, the first seen of equals."""
    order = Window.partitionBy("name").orderBy(F.desc("n"), "first", "value")
    return hist.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def largest(rows: DataFrame, size: Column, tie: str, limit: int = 20) -> DataFrame:
    return rows.withColumn("size", size).orderBy(F.desc("size"), tie).limit(limit)


def corpus_stats(docs: DataFrame, chunks: DataFrame, terms: DataFrame, top: int = 20, shown_aliases: int = 25) -> dict[str, DataFrame]:
    """The tables of a statistics report: histograms, totals (one row), largest_chunks and largest_alias_sets.

    Histograms are name, value, n: all of a table in one pass, those of domains and series cut to the most frequent.
    """
    whole = histograms(docs, {c: F.col(c) for c in ("source", "domain", "subculture")}, F.col("document_id"))
    news = docs.filter(F.col("source") == "news")
    series = F.when(blank(F.col("series_primary")), "none").otherwise(F.col("series_primary"))
    of_news = histograms(news, {"news_year": F.col("year"), "news_series": series}, F.col("document_id"))
    issues = histograms(news.select("document_id", F.explode("style_issues").alias("issue")), {"news_style_issue": F.col("issue")}, F.col("document_id"))
    of_chunks = histograms(chunks, {c: F.col(c) for c in ("source_type", "chunk_type")}, F.col("chunk_id"))
    shown = top_values(whole.unionByName(of_news).unionByName(issues).unionByName(of_chunks), 1 << 30)
    sums = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(blank(F.col("text"))).alias("empty_chunks"))
    of_terms = terms.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum(F.size("aliases")), F.lit(0)).alias("aliases"))
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    return {
        "histograms": shown.filter(~F.col("name").isin("domain", "news_series") | (F.col("rank") <= top)).select("name", "value", "n"),
        "totals": structure_totals(docs).crossJoin(sums).crossJoin(of_terms),
        "largest_chunks": largest(chunks.select("chunk_id", "title", "chunk_type", "source_type", "url", "text"), F.length("text"), "chunk_id", top).select("chunk_id", "title", "chunk_type", "source_type", F.col("size").alias("chars"), words.alias("words"), "url"),
        "largest_alias_sets": largest(terms, F.size("aliases"), "canonical", top).select("canonical", F.col("size").alias("alias_count"), F.slice("aliases", 1, shown_aliases).alias("aliases")),
    }


def structure_totals(docs: DataFrame) -> DataFrame:
    """Sums of the documents' counters; a counter that is no number counts as 0."""
    total = lambda c: F.sum(F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint"))).alias(c)
    have = [c for c in ("section_count", "edge_count", "citation_count", "table_count", "formula_count", "image_count") if c in docs.columns]
    empty = F.size(F.filter(F.coalesce("sections", F.array()), lambda s: blank(s["text"]))) if "sections" in docs.columns else F.lit(0)
    return docs.agg(F.count(F.lit(1)).alias("documents"), *[total(c) for c in have], F.sum(empty).alias("empty_sections"))


def issue(severity: str, kind: str, message: str | Column, artifact: str, identifier: Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), text.alias("message"), F.lit(artifact).alias("artifact"), identifier.alias("identifier"))


def issues_of(rows: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    """All rules in one scan: each gives an issue or nothing."""
    return rows.select(F.inline(F.array_compact(F.array(*[F.when(when, what) for when, what in rules]))))


def repeats(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key an earlier row has."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_nth > 1").drop("_nth")


def validate_documents(docs: DataFrame) -> DataFrame:
    """``docs``: document_id, ordinal, source, title, repo_rel_path, url, sections, date_iso, preview_paragraph, style_issues."""
    who = F.col("document_id")
    empty = F.size(F.filter(F.coalesce("sections", F.array()), lambda s: blank(s["text"])))
    n = F.size(F.coalesce("sections", F.array()))
    news = F.col("source") == "news"
    style = F.filter(F.coalesce("style_issues", F.array().cast("array<string>")), lambda s: s != "missing_banner_image")
    rules = [(blank(F.col(c)), issue("error", "missing_document_field", f"Missing `{c}`", "documents", who)) for c in ("source", "title", "repo_rel_path", "url")]
    rules += [
        (n == 0, issue("warning", "missing_sections", "Document has no sections", "documents", who)),
        ((n > 0) & (empty == n), issue("info", "only_empty_sections", "Document has sections but none contain text", "documents", who)),
        ((empty < n) & (empty > MANY_EMPTY), issue("info", "many_empty_sections", F.concat(F.lit("Document has "), empty.cast("string"), F.lit(" empty layout sections")), "documents", who)),
        (news & ~F.coalesce(F.col("date_iso"), F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}T"), issue("warning", "invalid_news_date", "News post has invalid or missing date_iso", "documents", who)),
        (news & blank(F.col("preview_paragraph")), issue("warning", "missing_news_preview", "News post has no preview paragraph", "documents", who)),
        (news & (F.size(style) > 0), issue("info", "news_style_issues", F.concat(F.lit("News post has style issues: "), F.array_join(F.slice(style, 1, 8), ", ")), "documents", who)),
    ]
    again = repeats(docs, "document_id", "ordinal").select(F.inline(F.array(issue("error", "duplicate_document_id", "Duplicate document identifier", "documents", who))))
    return issues_of(docs, rules).unionByName(again)


def validate_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks``: chunk_id, document_id, chunk_index, text, url, chunk_type and, for tables, table_headers."""
    who = F.col("chunk_id")
    headers = F.size(F.coalesce(F.col("table_headers"), F.array().cast("array<string>"))) == 0 if "table_headers" in chunks.columns else F.lit(False)
    rules = [
        (blank(F.col("text")), issue("error", "empty_chunk_text", "Chunk text is empty", "chunks", who)),
        (blank(F.col("url")), issue("warning", "missing_chunk_url", "Chunk has no url", "chunks", who)),
        (blank(F.col("chunk_type")), issue("warning", "missing_chunk_type", "Chunk has no chunk_type metadata", "chunks", who)),
        (F.length("text") > LARGE_CHUNK, issue("warning", "large_chunk", F.concat(F.lit("Chunk has "), F.length("text").cast("string"), F.lit(" characters")), "chunks", who)),
        ((F.col("chunk_type") == "table") & headers, issue("info", "table_missing_headers", "Table chunk has no table_headers metadata", "chunks", who)),
    ]
    again = repeats(chunks, "chunk_id", "chunk_index").select(F.inline(F.array(issue("error", "duplicate_chunk_id", "Duplicate chunk identifier", "chunks", who))))
    many = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MANY_CHUNKS)
    many = many.select(F.inline(F.array(issue("info", "many_chunks_per_document", F.concat(F.lit("Document produced "), F.col("n").cast("string"), F.lit(" chunks")), "chunks", F.col("document_id")))))
    return issues_of(chunks, rules).unionByName(again).unionByName(many)


def validate_entities(terms: DataFrame) -> DataFrame:
    """``terms``: canonical, aliases."""
    who = F.col("canonical")
    noisy = F.filter("aliases", lambda a: casefold(a).isin(*VALIDATOR_STOPWORDS))
    rules = [
        (F.size(noisy) > 0, issue("error", "stopword_alias", F.concat(F.lit("Entity has stopword aliases: "), F.array_join(noisy, ", ")), "terms", who)),
        (F.size("aliases") > MANY_ALIASES, issue("info", "large_alias_set", F.concat(F.lit("Entity has "), F.size("aliases").cast("string"), F.lit(" aliases")), "terms", who)),
    ]
    again = repeats(terms.withColumn("_key", casefold(F.col("canonical"))), "_key", "canonical").select(F.inline(F.array(issue("warning", "duplicate_entity", "Duplicate canonical entity", "terms", who))))
    return issues_of(terms, rules).unionByName(again)


def issue_summary(issues: DataFrame) -> DataFrame:
    return histograms(issues, {"severity": F.col("severity"), "kind": F.col("kind")}).select("name", "value", "n")


def validation_report(issues: DataFrame, kinds: int = 50) -> DataFrame:
    """One row: issues, by_severity, and by_kind of the ``kinds`` most frequent, as lists of (value, n), the most frequent first."""
    counts = top_values(histograms(issues, {"severity": F.col("severity"), "kind": F.col("kind")}), kinds)
    listed = lambda name: F.array_sort(F.collect_list(F.when(F.col("name") == name, F.struct((-F.col("n")).alias("_by"), "value", "n"))))
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["value"], x["n"]))
    total = F.coalesce(F.sum(F.when(F.col("name") == "severity", F.col("n"))), F.lit(0).cast("long"))
    return counts.agg(total.alias("issues"), plain(listed("severity")).alias("by_severity"), plain(listed("kind")).alias("by_kind"))
