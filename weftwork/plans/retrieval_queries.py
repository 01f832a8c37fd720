"""Queries about tokens, chunks, postings, scores and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.functions.text import context_window, path_prefixes
from weftwork.operators import chunking, evaluation, maxscore, mentions, prompting, retrieval, vectors
from weftwork.plans.sql import PAGE, TITLE, norm, packed, strip, terms
from weftwork.plans.tables import chunks_of, pages_of, questions, table
from weftwork.storage import materialized
from weftwork.vocab import ACCESS, EXPANSIONS, PERFORMANCE, TROUBLESHOOTING

TOP = 6


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = retrieval.term_counts(table(spark, d, "documents"), "doc_id", F.col("text"))
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


TERM_COUNTS = f"SELECT term, sum(n)::BIGINT AS n, count(*) AS n_docs FROM (SELECT doc_id, term, count(*) AS n FROM {terms('documents', 'doc_id', 'text')} GROUP BY 1, 2) GROUP BY term"


def overlap_scores(spark: SparkSession, d: str) -> DataFrame:
    asked = questions(table(spark, d, "benchmark"))
    bags = retrieval.term_counts(asked, "query_id", F.col("query"))
    over = retrieval.overlap(bags, table(spark, d, "documents"), "doc_id", F.col("text"), TOP)
    best = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "doc_id")
    return over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP)


def overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return overlap_scores(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "overlap", F.round(F.log1p(F.col("overlap").cast("double")), 6).alias("score"))


OVERLAP = f"""
WITH q AS (SELECT item_id AS query_id, term, count(*) AS n FROM {terms('benchmark', 'item_id', 'text')} GROUP BY 1, 2),
t AS (SELECT doc_id, term, count(*) AS n FROM {terms('documents', 'doc_id', 'text')} GROUP BY 1, 2),
o AS (SELECT query_id, doc_id, sum(least(q.n, t.n))::BIGINT AS overlap FROM q JOIN t USING (term) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS rank FROM o QUALIFY rank <= {TOP})
"""
OVERLAP_TOPK = OVERLAP + "SELECT query_id, rank, doc_id, overlap, round(ln(1 + overlap), 6) AS score FROM top"

def maxscore_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as chunk_terms_overlap_topk, from postings in blocks; every question reads blocks, and some are skipped."""
    asked = questions(table(spark, d, "benchmark"))
    top, blocks = maxscore.top_overlaps(retrieval.term_counts(asked, "query_id", F.col("query")), maxscore.term_bags(table(spark, d, "documents"), "doc_id", F.col("text")), "doc_id", TOP)
    read = blocks.select("query_id", (F.col("blocks_read") > 0).alias("read"))
    return top.join(read, "query_id").select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "overlap", "read")


MAXSCORE_TOPK = OVERLAP + "SELECT query_id, rank, doc_id, overlap, true AS read FROM top"

def title_mentions(spark: SparkSession, d: str) -> DataFrame:
    """All documents' titles of two words looked for in all documents: how many mention each, how often, and the first."""
    docs = table(spark, d, "documents")
    names = docs.select(F.regexp_extract(F.coalesce("text", F.lit("")), "^([A-Za-z]+ [A-Za-z]+)", 1).alias("name"))
    found = mentions.mentions(docs, names, "doc_id", "text")
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.min("start").cast("long").alias("least_start"))


TITLE_MENTIONS = """
WITH n AS (SELECT DISTINCT lower(regexp_extract(coalesce(text, ''), '^([A-Za-z]+ [A-Za-z]+)', 1)) AS name FROM documents),
d AS (SELECT doc_id, replace(lower(coalesce(text, '')), 'ß', 'ss') AS text FROM documents),
m AS (SELECT name, doc_id, text, regexp_extract(text, '^((?s:.*?)(?:^|[^a-z0-9]))' || name || '(?:[^a-z0-9]|$)', 1) AS head, regexp_matches(text, '(^|[^a-z0-9])' || name || '([^a-z0-9]|$)') AS ok FROM n JOIN d ON contains(d.text, n.name) WHERE name <> '')
SELECT name, count(*) AS n_docs, min(doc_id) AS first_doc, min(length(head)) AS least_start FROM m WHERE ok GROUP BY name
"""

INTENT_TOKENS = "lower(unnest(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9!+#.'']+')))"


def postings_candidates(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_matches(questions(table(spark, d, "benchmark")), chunks_of(table(spark, d, "documents")))


def document_scores(spark: SparkSession, d: str) -> DataFrame:
    intents = retrieval.with_intent(questions(table(spark, d, "benchmark")))
    scores = retrieval.document_scores(intents, pages_of(table(spark, d, "documents")))
    top = retrieval.top_documents(scores)
    return top.select("query_id", "document_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _intent_sql(source: str, key: str, text: str) -> str:
    """CTEs raw(key, w), flags(key, slow, trouble, access) and expanded(key, term)."""
    n = norm("trim(w, '''')")
    more = " UNION ".join(f"SELECT {key}, unnest([{_quoted(EXPANSIONS[name])}]) FROM flags WHERE {flag}" for name, flag in (("troubleshooting", "trouble"), ("performance", "slow"), ("access", "access")))
    hit = lambda words: f"coalesce(bool_or(w IN ({_quoted(words)}) OR stem IN ({_quoted(words)})), false)"
    return f"""
raw AS (SELECT {key}, w, {n} AS stem FROM (SELECT {key}, {INTENT_TOKENS.format(text=text)} AS w FROM {source})),
flags AS (SELECT {key}, {hit(PERFORMANCE)} AS slow, {hit(TROUBLESHOOTING)} AS trouble, {hit(ACCESS)} AS access FROM {source} LEFT JOIN raw USING ({key}) GROUP BY {key}),
expanded AS (SELECT DISTINCT {key}, term FROM (SELECT {key}, stem AS term FROM raw UNION {more}) WHERE term <> '')"""


DOCUMENT_SCORES = f"""
WITH b AS (SELECT item_id, text FROM benchmark), {_intent_sql('b', 'item_id', 'text')},
pages AS (SELECT doc_id, {PAGE} AS document_id, {TITLE} AS title, lang, source FROM documents),
q AS (SELECT item_id AS query_id, term, count(*) AS n FROM (SELECT * FROM {terms('b', 'item_id', 'text')} UNION ALL SELECT * FROM expanded) GROUP BY 1, 2),
body AS (SELECT document_id, concat_ws(' ', title, translate(document_id, '_/', '  '), lang, source, lang, 'general', source, 'Body') AS text FROM pages),
t AS (SELECT document_id, term, count(*) AS n FROM {terms('body', 'document_id', 'text')} GROUP BY 1, 2),
o AS (SELECT query_id, document_id, ln(1 + sum(least(q.n, t.n))) * 1.8 AS p FROM q JOIN t USING (term) GROUP BY 1, 2),
tags AS (SELECT query_id, document_id, count(*) * 2.5 AS p FROM (SELECT DISTINCT document_id, lower(unnest([lang, source])) AS term FROM pages) JOIN q USING (term) GROUP BY 1, 2),
titles AS (SELECT query_id, document_id, count(*) * 3.0 AS p FROM (SELECT DISTINCT document_id, term FROM {terms('pages', 'document_id', 'title')}) JOIN q USING (term) GROUP BY 1, 2),
tails AS (SELECT query_id, document_id, count(*) * 2.0 AS p FROM (SELECT DISTINCT document_id, term FROM {terms("(SELECT document_id, doc_id::VARCHAR AS tail FROM pages)", 'document_id', 'tail')}) JOIN q USING (term) GROUP BY 1, 2),
s AS (SELECT query_id, document_id, sum(p) AS score FROM (SELECT * FROM o UNION ALL SELECT * FROM tags UNION ALL SELECT * FROM titles UNION ALL SELECT * FROM tails) GROUP BY 1, 2)
SELECT query_id, document_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM s QUALIFY rank <= 12
"""


def ancestor_scores(spark: SparkSession, d: str) -> DataFrame:
    """Hosts and their languages score by their number of pages; pages inherit 0.7 of the best above them."""
    place = F.regexp_extract("url", r"://([^?#]*?)/?(?:[?#].*)?$", 1)
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("chunk_id"), place.alias("document_id"), F.lit("section").alias("chunk_type"))
    above = pages.select(F.explode(F.slice(path_prefixes(F.col("document_id")), 1, 2)).alias("document_id"))
    scores = above.groupBy("document_id").agg(F.count(F.lit(1)).cast("double").alias("score")).withColumn("query_id", F.lit(1))
    return retrieval.chunk_document_scores(scores, pages).select("chunk_id", F.round("document_score", 6).alias("document_score"))


ANCESTOR_SCORES = r"""
WITH p AS (SELECT page_id::VARCHAR AS chunk_id, regexp_extract(url, '://([^?#]*?)/?(?:[?#].*)?$', 1) AS document_id FROM pages),
up AS (SELECT chunk_id, document_id, array_to_string(string_split(document_id, '/')[1:i], '/') AS above FROM (SELECT *, unnest(range(1, len(string_split(document_id, '/')) + 1)) AS i FROM p)),
s AS (SELECT above AS place, count(*)::DOUBLE AS score FROM (SELECT * FROM up WHERE len(string_split(above, '/')) <= 2) GROUP BY 1),
m AS (SELECT chunk_id, max(CASE WHEN place = document_id THEN score END) AS own, max(CASE WHEN place <> document_id THEN score * 0.7 END) AS above FROM up JOIN s ON up.above = s.place GROUP BY 1)
SELECT chunk_id, round(coalesce(own, above), 6) AS document_score FROM m
"""


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 100."""
    rows = table(spark, d, "embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    top = retrieval.dense_scores(asked, rows.select(F.col("vec_id").alias("chunk_id"), "embedding"))
    return top.select("query_id", "chunk_id", F.round("dense_score", 6).alias("dense_score"))


DENSE_TOPK = """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
SELECT query_id, chunk_id, round(score, 6) AS dense_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s) WHERE r <= 24
"""


def dense_index(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of the same queries from the inverted-file index: how much of the exact answer it finds.

    Every query has its k rows, scores never exceed the exact ones of their rank, and at least nine in ten rows of the exact
    answer are found.
    """
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = rows.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = materialized(vectors.nearest_to(asked, rows, retrieval.DENSE_TOP_K))
    exact = materialized(retrieval.dense_scores(asked, rows))
    both = exact.join(found, ["query_id", "chunk_id"], "left").agg(F.count("*").alias("n_exact"), (F.count("score") / F.count("*") >= 0.9).alias("recall_reached"), F.coalesce(F.max(F.abs(F.col("score") - F.col("dense_score"))) < 1e-5, F.lit(True)).alias("scores_agree"))
    return found.agg(F.count("*").alias("n_found"), F.countDistinct("query_id").alias("n_queries"), F.coalesce(F.max("rank"), F.lit(0)).cast("long").alias("k")).crossJoin(both)  # two single rows


DENSE_INDEX = """
WITH q AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT least(24, count(*)) AS k FROM embeddings)
SELECT n * k AS n_found, n AS n_queries, k, n * k AS n_exact, true AS recall_reached, true AS scores_agree FROM q, v
"""


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """All passages as questions over all chunks: lexical, document and dense scores together."""
    docs = table(spark, d, "documents")
    asked, embedded = questions(table(spark, d, "benchmark")), table(spark, d, "embeddings")
    chunks, pages = chunks_of(docs), pages_of(docs)
    ids = docs.select(F.col("doc_id").alias("vec_id"), F.concat(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")), F.lit("::article")).alias("chunk_id"))
    query_vectors = embedded.join(asked, F.col("vec_id") == F.col("query_id"), "inner").select("query_id", F.col("embedding").alias("query_embedding"))
    dense = retrieval.dense_scores(query_vectors, embedded.join(ids, "vec_id").select("chunk_id", "embedding"))
    found = retrieval.search(asked, chunks, pages, dense=dense)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", *[F.round(c, 6).alias(c) for c in ("score", "dense_score", "keyword_score", "document_score")])


def intents(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return retrieval.with_intent(said).select("query_id", F.array_join("labels", ",").alias("labels"), F.size("expanded").cast("long").alias("n_terms"), F.md5(F.array_join("expanded", " ")).alias("terms_md5"))


INTENTS = f"""
WITH b AS (SELECT conv_id || ':' || turn AS query_id, coalesce(text, '') AS text FROM conversations WHERE role = 'user'), {_intent_sql('b', 'query_id', 'text')},
e AS (SELECT query_id, count(*) AS n_terms, string_agg(term, ' ' ORDER BY term) AS all_terms FROM expanded GROUP BY 1)
SELECT query_id, concat_ws(',', CASE WHEN access THEN 'access' END, CASE WHEN regexp_matches(text, '(?i)\\bwhat\\s+(?:is|are)\\b|\\bdefine\\b|\\bmeaning\\s+of\\b') THEN 'definition' END,
  CASE WHEN slow THEN 'performance' END, CASE WHEN trouble OR slow THEN 'troubleshooting' END) AS labels, coalesce(n_terms, 0) AS n_terms, md5(coalesce(all_terms, '')) AS terms_md5
FROM b JOIN flags USING (query_id) LEFT JOIN e USING (query_id)
"""


def pack_blocks(spark: SparkSession, d: str) -> DataFrame:
    parts = chunking.split_text_blocks(F.col("text"), 1200)
    return table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("part", "text")).select("doc_id", F.col("part").cast("long").alias("part"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


_LINES = f"list_filter(list_transform(string_split(body, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"


def packed_parts(limit: int) -> str:
    """CTEs b(doc_id, body) and p(doc_id, body, parts): each text packed into parts of at most ``limit`` characters."""
    words = packed("list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')", limit, " ")
    return f"""
b AS (SELECT doc_id, lang, source, text, {strip("coalesce(text, '')")} AS body FROM documents),
l AS (SELECT *, list_transform({_LINES}, lambda x: CASE WHEN length(x) > {limit} THEN {words} ELSE [x] END) AS nested FROM b),
p AS (SELECT * EXCLUDE (nested), CASE WHEN body = '' THEN [] WHEN length(body) <= {limit} THEN [body] ELSE {packed('flatten(nested)', limit, chr(92) + 'n' + chr(92) + 'n')} END AS parts FROM l)"""


PACK_BLOCKS = f"WITH {packed_parts(1200)} SELECT doc_id, unnest(range(0, len(parts))) AS part, length(unnest(parts)) AS n_chars, md5(unnest(parts)) AS text_md5 FROM p"


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    made = chunks_of(table(spark, d, "documents"))
    return made.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.max("chunk_index").cast("long").alias("last_index"), F.count_if(F.col("chunk_type") == "section").alias("n_sections"))


SECTION_HEADER = "'Article: ' || title || chr(10) || 'Section: Body' || chr(10) || 'Heading path: Body' || chr(10) || chr(10)"
CHUNKED = packed_parts(chunking.MAX_CHUNK_CHARS - 300) + f""",
c AS (SELECT *, {PAGE} AS document_id, {TITLE} AS title FROM p),
h AS (SELECT *, CASE WHEN length(body) > 1400 THEN regexp_replace(left(body, 1400), '\\s+$', '') || '...' ELSE body END AS intro FROM c)"""
CHUNK_DOCUMENTS = f"""
WITH {CHUNKED}, n AS (SELECT *, 'Title: ' || title || CASE WHEN trim(coalesce(lang, '')) <> '' THEN chr(10) || 'Domain: ' || trim(lang) ELSE '' END || chr(10) || 'Subculture: general'
  || CASE WHEN intro <> '' THEN chr(10) || chr(10) || 'Intro excerpt:' || chr(10) || intro ELSE '' END AS article FROM h)
SELECT document_id, sum(1 + len(parts))::BIGINT AS n_chunks, sum(length(article) + coalesce(list_sum(list_transform(parts, lambda x: length({SECTION_HEADER} || x))), 0))::BIGINT AS n_chars,
  max(len(parts))::BIGINT AS last_index, sum(len(parts))::BIGINT AS n_sections FROM n GROUP BY 1
"""
_SECTIONS = "SELECT document_id, title, lang, source, 'section' AS kind, 'Body' AS heading, document_id || '::section::body' || CASE WHEN len(parts) > 1 THEN '::part-' || unnest(range(1, len(parts) + 1)) ELSE '' END AS chunk_id FROM c WHERE len(parts) > 0"
POSTINGS = f"""
WITH {CHUNKED}, k AS (SELECT document_id, title, lang, source, 'article' AS kind, title AS heading, document_id || '::article' AS chunk_id FROM c UNION ALL {_SECTIONS}),
m AS (SELECT *, concat_ws(' ', title, heading, coalesce(lang, ''), coalesce(source, ''), document_id || '.md', kind, coalesce(lang, ''), 'general') AS meta FROM k),
i AS (SELECT chunk_id, term FROM {terms('m', 'chunk_id', 'meta')} UNION SELECT chunk_id, lower(unnest([title, heading, lang, source, kind])) AS term FROM k),
q AS (SELECT DISTINCT item_id, term FROM {terms('benchmark', 'item_id', 'text')})
SELECT item_id AS query_id, count(DISTINCT chunk_id) AS n_chunks, min(chunk_id) AS first_chunk FROM q JOIN i USING (term) WHERE term <> '' GROUP BY 1
"""


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """What surrounds the middle of each text."""
    middle = F.floor(F.length("text") / 2).cast("int")
    return table(spark, d, "documents").select("doc_id", F.md5(context_window(F.col("text"), middle, middle + 10)).alias("context_md5"))


CONTEXTS = f"""
WITH m AS (SELECT doc_id, text, length(text) // 2 AS s FROM documents)
SELECT doc_id, md5({strip("regexp_replace(substr(text, greatest(s - 160, 0) + 1, least(s + 170, length(text)) - greatest(s - 160, 0)), '\\s+', ' ', 'g')")}) AS context_md5 FROM m
"""


def hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """Passages as questions, the documents that hold them as expectations, by the passage's first letter."""
    asked = questions(table(spark, d, "benchmark"))
    docs = table(spark, d, "documents")
    holds = evaluation.texts_with_passages(docs.select(F.col("doc_id").cast("string").alias("doc"), F.col("text").alias("body")), asked)
    expected = holds.groupBy("query_id").agg(F.collect_set("doc").alias("expected_document_ids"))
    examples = asked.join(expected, "query_id", "left").select("query_id", F.lower(F.substring("query", 1, 1)).alias("category"), "expected_document_ids", F.array().cast("array<string>").alias("expected_chunk_ids"))
    results = overlap_scores(spark, d).select("query_id", "rank", F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"))
    out = evaluation.summarize(evaluation.score_retrieval(examples, results))
    return out.select(F.coalesce("category", F.lit("(all)")).alias("category"), "examples", "judged_examples", "matches", F.round("retrieval_accuracy", 6).alias("retrieval_accuracy"))


HIT_RATES = OVERLAP + """,
e AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
s AS (SELECT item_id, lower(left(text, 1)) AS category, (item_id IN (SELECT item_id FROM e))::INT AS judged,
  (item_id IN (SELECT item_id FROM e JOIN top ON e.item_id = top.query_id AND e.doc_id = top.doc_id))::INT AS hit FROM benchmark)
SELECT coalesce(category, '(all)') AS category, count(*) AS examples, sum(judged)::BIGINT AS judged_examples, sum(hit)::BIGINT AS matches, round(coalesce(sum(hit) / nullif(sum(judged), 0), 0), 6) AS retrieval_accuracy
FROM s GROUP BY ROLLUP (category)
"""


def prompts(spark: SparkSession, d: str) -> DataFrame:
    asked = questions(table(spark, d, "benchmark"))
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.array("lang", "source").alias("heading_path"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), "text")
    made = prompting.build_prompts(asked, overlap_scores(spark, d).select("query_id", "rank", F.col("doc_id").alias("chunk_id")), chunks)
    return made.select("query_id", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


_HEAD = prompting.INSTRUCTIONS.replace("'", "''").replace("\n", "' || chr(10) || '")
PROMPTS = OVERLAP + f""",
c AS (SELECT query_id, string_agg('[' || rank || '] ' || source || ' | ' || lang || ' > ' || source || chr(10) || 'URL: doc:' || doc_id || chr(10) || 'Text:' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM top JOIN documents USING (doc_id) GROUP BY 1),
p AS (SELECT query_id, '{_HEAD}' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Answer:' AS prompt FROM c JOIN benchmark ON item_id = query_id)
SELECT query_id, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM p
"""

QUERIES = {
    "tokenize_term_counts": (term_counts, TERM_COUNTS),
    "chunk_terms_overlap_topk": (overlap_topk, OVERLAP_TOPK),
    "postings_semi_join": (postings_candidates, POSTINGS),
    "document_scores": (document_scores, DOCUMENT_SCORES),
    "ancestor_rollup": (ancestor_scores, ANCESTOR_SCORES),
    "dense_topk": (dense_topk, DENSE_TOPK),
    "overlap_topk_blocks": (maxscore_topk, MAXSCORE_TOPK),
    "title_mentions": (title_mentions, TITLE_MENTIONS),
    "dense_index_recall": (dense_index, DENSE_INDEX),
    "hybrid_rank": (hybrid_search, None),
    "intent_labels": (intents, INTENTS),
    "text_pack_blocks": (pack_blocks, PACK_BLOCKS),
    "chunk_documents": (chunk_documents, CHUNK_DOCUMENTS),
    "context_window": (contexts, CONTEXTS),
    "hit_rate_rollup": (hit_rates, HIT_RATES),
    "prompt_context": (prompts, PROMPTS),
}
