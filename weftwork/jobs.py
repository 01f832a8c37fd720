"""Jobs from tables to tables: ingest, terms, links, entities, normalisation, reports, index, search, evaluation."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions.text import casefold
from weftwork.operators import chunking, entities, evaluation, indexing, links, prompting, reports, retrieval, structure, terms, vectors
from weftwork.operators.ordering import in_ranges
from weftwork.sources import files, sinks
from weftwork.sources.config import Config
from weftwork.storage import checkpoint_root, materialized
from weftwork.streaming.indexing import hashing_vector, index_stream, live_points, points_of, sync_into, upsert_into
from weftwork.streaming.progress import EVENTS
from weftwork.vocab import Vocabulary


def table(spark: SparkSession, config: Config, name: str) -> DataFrame:
    path = config.artifacts.reads(name)
    if not files.qualified(spark, path)[1]:
        raise FileNotFoundError(f"{path} is missing: run the step that writes {name} first")
    return files.read_table(spark, path)


def ingest(spark: SparkSession, config: Config, vocab: Vocabulary = Vocabulary()) -> dict:  # noqa: B008
    """Markdown files to documents and chunks, and a report of what was made."""
    found = files.markdown_files(spark, config.corpus.path, config.corpus.lang)
    sinks.write_table(structure.parse_pages(found, vocab, config.corpus.lang), config.artifacts.writes("documents"))
    docs = spark.read.parquet(config.artifacts.writes("documents"))
    sinks.write_table(chunking.build_chunks(docs), config.artifacts.writes("chunks"))
    chunks = spark.read.parquet(config.artifacts.writes("chunks"))
    by_source = docs.agg(F.count_if(F.col("source") == "wiki").alias("wiki_documents"), F.count_if(F.col("source") == "news").alias("news_documents"))
    report = reports.structure_totals(docs).crossJoin(by_source).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))
    return sinks.write_report(report, config.artifacts.writes("ingest_report"))


def build_terms(spark: SparkSession, config: Config, vocab: Vocabulary = Vocabulary()) -> dict:  # noqa: B008
    made = terms.build_terms(table(spark, config, "documents"), vocab)
    sinks.write_records(in_ranges(made, F.lower("canonical"), "canonical"), config.artifacts.writes("terms"))
    return sinks.write_report(terms.terms_report(files.read_entities(spark, config.artifacts.writes("terms"))), config.artifacts.writes("terms_report"))


def build_links(spark: SparkSession, config: Config) -> dict:
    """Link rows, alias candidates, review files by decision and a report."""
    docs = table(spark, config, "documents")
    sinks.write_table(links.link_rows(docs), config.artifacts.writes("links"))
    rows = spark.read.parquet(config.artifacts.writes("links"))
    sinks.write_table(links.link_candidates(rows, links.known_pages(docs)), config.artifacts.writes("link_candidates"))
    candidates = spark.read.parquet(config.artifacts.writes("link_candidates"))
    sinks.write_review(links.review_rows(links.in_review_order(candidates)), config.artifacts.writes("link_review"))
    return sinks.write_report(links.link_report(rows, candidates, docs), config.artifacts.writes("links_report"))


def extract_entities(spark: SparkSession, config: Config, backend: str, options: dict, profile: str = "default", limit: int | None = None, sampling: str = "balanced", scoped: bool = False, vocab: Vocabulary = Vocabulary(), labels: list[str] | None = None, max_text_chars: int = entities.MAX_TEXT_CHARS) -> dict:  # noqa: B008
    """Mentions in all chunks, or in a sample of ``limit`` chunks if one is asked for; ``labels`` stand in for the profile's."""
    chunks = table(spark, config, "chunks").withColumn("ordinal", F.struct("document_id", "chunk_index"))
    chosen = entities.select_chunks(chunks, limit, sampling)
    made = entities.extract_entities(chosen, backend, options, labels or entities.labels_for_profile(profile, vocab), vocab, scoped, max_text_chars)
    sinks.write_table(in_ranges(made, F.desc("score"), "label", casefold(F.col("canonical_guess")), "chunk_id", "start"), config.artifacts.writes("entity_candidates"))
    return sinks.write_report(entities.candidate_report(spark.read.parquet(config.artifacts.writes("entity_candidates"))), config.artifacts.writes("entity_candidates_report"))


def normalize_entities(spark: SparkSession, config: Config, full_merge: bool = False, vocab: Vocabulary = Vocabulary()) -> dict:  # noqa: B008
    docs = table(spark, config, "documents").filter(F.col("source") == "wiki")
    made = entities.normalize_candidates(table(spark, config, "entity_candidates"), entities.document_index(docs), vocab, full_merge)
    sinks.write_table(in_ranges(made, links.decision_order(F.col("decision")), F.desc("confidence"), casefold(F.col("canonical")), "canonical"), config.artifacts.writes("entities"))
    rows = spark.read.parquet(config.artifacts.writes("entities"))
    sinks.write_review(entities.normalization_review_rows(rows), config.artifacts.writes("entity_review"))
    return sinks.write_report(entities.normalization_report(rows), config.artifacts.writes("entities_report"))


def stats(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """Histograms, totals, the largest chunks and alias sets, each written as a table below ``stats``."""
    known = files.read_entities(spark, config.artifacts.reads("terms"))
    made = reports.corpus_stats(table(spark, config, "documents"), table(spark, config, "chunks"), known)
    for name, rows in made.items():
        sinks.write_table(rows, config.artifacts.writes(f"stats/{name}"))
    return {name: spark.read.parquet(config.artifacts.writes(f"stats/{name}")) for name in made}


def validate(spark: SparkSession, config: Config) -> DataFrame:
    """All issues of documents, chunks and, if there are any, terms; and a report of their numbers."""
    issues = reports.validate_documents(table(spark, config, "documents")).unionByName(reports.validate_chunks(table(spark, config, "chunks")))
    issues = issues.unionByName(reports.validate_entities(files.read_entities(spark, config.artifacts.reads("terms"))))
    sinks.write_table(issues, config.artifacts.writes("issues"))
    issues = spark.read.parquet(config.artifacts.writes("issues"))
    sinks.write_report(reports.validation_report(issues), config.artifacts.writes("validation_report"))
    return issues


def build_index(spark: SparkSession, config: Config, resume: bool = True, offset: int = 0, limit: int | None = None, sync: bool = False, files_per_batch: int = 64, tell: Callable[[dict], None] | None = None) -> dict:
    """Bring the index up to date with the chunk files; without ``resume`` all of them are taken again.

    What is done is known by file, and an event for each batch is written and passed to ``tell``. With ``sync`` contents are
    compared instead: only what is new, changed or gone since the last time is touched. With an ``offset`` or a ``limit``
    those chunks alone are taken, in order of document and place, and nothing is marked as done; an offset below 0 is 0.
    """
    offset = max(0, offset)
    if limit is not None and limit <= 0:
        raise ValueError("limit must be above zero")
    if files_per_batch <= 0:
        raise ValueError("files of a batch must be above zero")
    if sync and (offset or limit is not None):
        raise ValueError("sync takes all chunks: no offset and no limit")
    checkpoint_root(spark)
    began = time.monotonic()
    chunks, index = config.artifacts.reads("chunks"), config.artifacts.writes("index")
    rows = table(spark, config, "chunks")
    if not (n := rows.count()):
        raise ValueError("there are no chunks: run ingest first")
    if offset >= n:
        raise ValueError(f"offset {offset} is past the {n} chunks that there are")
    states = config.artifacts.writes("index_checkpoint")
    encode = lambda text: hashing_vector(text, config.embedding.dimensions)
    changed, events = {}, []
    if sync:
        changed = sync_into(rows, index, encode)
    elif offset or limit is not None:
        chosen = rows.orderBy("document_id", "chunk_index", "chunk_id").offset(offset)
        upsert_into(points_of(chosen if limit is None else chosen.limit(limit), encode), index)
    else:
        if not resume:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(states)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        events = index_stream(spark, chunks, index, states, encode, files_per_batch, tell)
        if events:
            sinks.write_records(spark.createDataFrame(events, EVENTS), config.artifacts.writes("index_events"))
    seconds = time.monotonic() - began
    more = [F.lit(round(seconds, 3)).alias("seconds"), *[F.lit(n).alias(f"{c}s") for c, n in changed.items()]]
    counts = live_points(spark.read.parquet(index)).agg(F.count(F.lit(1)).alias("points")).select("points", *more)
    return sinks.write_report(counts, config.artifacts.writes("index_report"))


def search(spark: SparkSession, config: Config, queries: DataFrame, dense: bool = False, vocab: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """Ranked chunks of ``queries(query_id, query)``; with ``dense`` the index's vectors count too."""
    chunks = table(spark, config, "chunks")
    docs = table(spark, config, "documents").withColumn("section_parts", F.flatten(F.transform("sections", lambda s: F.concat(F.array(s["title"]), s["heading_path"]))))
    scores = None
    if dense:
        points = live_points(table(spark, config, "index")).select("payload.chunk_id", F.col("vector").alias("embedding"))
        asked = queries.select("query_id", hashing_vector(F.col("query"), config.embedding.dimensions).alias("query_embedding"))
        found = vectors.nearest_to(asked, points, config.retrieval.dense_top_k, config.retrieval.dense_missed)
        scores = found.select("query_id", "chunk_id", F.col("score").alias("dense_score"))
    names = None if dense else files.read_entities(spark, config.artifacts.reads("terms"))
    return retrieval.search(queries, indexing.last_by_id(chunks, "chunk_id", "chunk_index"), docs, names, scores, config.retrieval.final_top_k, vocab, config.retrieval.dense_top_k)


def prompts(spark: SparkSession, config: Config, queries: DataFrame, dense: bool = False, vocab: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """query_id and prompt of each question."""
    return prompting.build_prompts(queries, search(spark, config, queries, dense, vocab), table(spark, config, "chunks"))


def answers(spark: SparkSession, config: Config, queries: DataFrame, generate: Callable[[str], str], dense: bool = False, vocab: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """query_id and answer of each question; those without results, and empty answers, get the refusal."""
    return prompting.answer(queries, prompts(spark, config, queries, dense, vocab), generate)


def evaluate(spark: SparkSession, config: Config, path: str, dense: bool = False, vocab: Vocabulary = Vocabulary(), output: str | None = None) -> DataFrame:  # noqa: B008
    """Hit rates of all questions of a file, in all and by category; the questions' own rows go to ``output``."""
    examples = files.read_examples(spark, path)
    found = materialized(search(spark, config, examples.select("query_id", "query"), dense, vocab))
    where = output or config.artifacts.writes("evaluation")
    sinks.write_records(evaluation.per_question(examples, found), where)
    return evaluation.summarize(evaluation.score_retrieval(examples, found))
