"""Queries about links, terms, entities, quality reports and index points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions.text import acronym, normalize_term, plural_alias
from weftwork.operators import entities, indexing, links, reports, taxonomy, terms
from weftwork.operators.retrieval import detect_entities
from weftwork.operators.chunking import build_chunks
from weftwork.plans.retrieval_queries import SECTION_HEADER, packed_parts
from weftwork.plans.sql import PAGE, STOP, TITLE, strip
from weftwork.plans.tables import linked_pages, pages_of, questions, table
from weftwork.storage import materialized
from weftwork.vocab import GENERIC_ANCHORS, NOISE_TERMS


#: Characters of a chunk, for a report of chunks that are too large.
LARGE_CHUNKS = 30_000


def alias_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = links.link_candidates(links.link_rows(linked_pages(table(spark, d, "pages"))))
    return found.select("alias", "alias_key", "target_page_id", "decision", "decision_reason", F.round("confidence", 6).alias("confidence"), "source_count", "link_count", "target_count", "ambiguous_target_count")


_GENERIC = ", ".join("'" + w + "'" for w in GENERIC_ANCHORS)
_KEY = "lower(trim(regexp_replace(translate({}, '_-', '  '), '\\s+', ' ', 'g')))"
ALIAS_CANDIDATES = rf"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS tag, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) AS pos FROM pages),
m AS (SELECT page_id, pos, regexp_extract(tag, '>([^<]*)<', 1) AS raw, regexp_replace(regexp_replace(trim(regexp_extract(tag, 'href="/?([^"]*)"', 1)), '^/+|/+$', '', 'g'), '^wiki/', '') AS target FROM a),
t AS (SELECT page_id, pos, target, {strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '`([^`]+)`', '\\1', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g'), '\\s+', ' ', 'g')")} AS text FROM m),
k AS (SELECT *, replace({_KEY.format('text')}, 'ß', 'ss') AS key FROM t WHERE target <> '' AND NOT starts_with(target, 'news/')),
u AS (SELECT * FROM k WHERE key <> ''),
tc AS (SELECT key, target, count(*) AS n, min((page_id, pos)) AS first FROM u GROUP BY 1, 2),
tr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS r FROM tc),
tx AS (SELECT key, text, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min((page_id, pos))) AS r FROM u GROUP BY 1, 2),
g AS (SELECT key, max(CASE WHEN r = 1 THEN target END) AS target, max(CASE WHEN r = 1 THEN n END) AS tcount, count(*) AS amb, sum(n)::BIGINT AS links FROM tr GROUP BY 1),
s AS (SELECT key, count(DISTINCT page_id) AS sources FROM u GROUP BY 1),
j AS (SELECT g.*, s.sources, tx.text AS alias, replace({_KEY.format("regexp_extract(g.target, '([^/]*)$', 1)")}, 'ß', 'ss') AS tail, replace({_KEY.format("replace(g.target, '/', ' ')")}, 'ß', 'ss') AS full_key,
  key IN ({_GENERIC}) OR regexp_full_match(key, '(read|see|learn) (this|more|here|article|page)|.{{0,40}}\bwiki page|\d{{4}}') AS generic FROM g JOIN s USING (key) JOIN tx USING (key) WHERE tx.r = 1),
c AS (SELECT *, greatest(0.0, least(1.0, 0.25 + least(0.22, tcount / 25) + least(0.18, sources / 20) + 0.25 * (tcount / links)
  + CASE WHEN key = tail THEN 0.25 WHEN contains(full_key, key) OR contains(key, tail) THEN 0.12 ELSE 0 END - CASE WHEN amb > 1 THEN least(0.35, 0.08 * (amb - 1)) ELSE 0 END
  - CASE WHEN generic THEN 0.6 ELSE 0 END - CASE WHEN length(key) < 3 THEN 0.3 ELSE 0 END)) AS conf FROM j)
SELECT alias, key AS alias_key, target AS target_page_id, round(conf, 6) AS confidence, sources AS source_count, links AS link_count, tcount AS target_count, amb AS ambiguous_target_count,
  CASE WHEN generic OR conf < 0.35 THEN 'reject' WHEN conf >= 0.78 AND amb <= 2 AND (sources >= 2 OR links >= 4) THEN 'accept' ELSE 'review' END AS decision,
  CASE WHEN generic THEN 'generic_anchor' WHEN conf < 0.35 THEN 'low_confidence' WHEN amb > 2 THEN 'ambiguous_targets' WHEN conf >= 0.78 AND (sources >= 2 OR links >= 4) THEN 'repeated_high_confidence'
    WHEN sources < 2 AND links < 4 THEN 'weak_single_source_evidence' WHEN amb > 1 THEN 'minor_target_ambiguity' ELSE 'needs_manual_confirmation' END AS decision_reason
FROM c
"""


def named_things(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c, s: table(spark, d, t).select(F.col(c).alias("raw"), F.lit(s).alias("source"), F.col(c).alias("hint"))
    return one("part", "p_name", "part").unionByName(one("nation", "n_name", "nation")).unionByName(one("region", "r_name", "region")).unionByName(one("part", "p_type", "type"))


def term_aliases(spark: SparkSession, d: str) -> DataFrame:
    merged = terms.merge_terms(terms.add_terms(named_things(spark, d)))
    return merged.select("canonical", F.array_join("aliases", "|").alias("aliases"), F.array_join("sources", "|").alias("sources"), F.round("score", 6).alias("score"))


_USEFUL = "length({0}) BETWEEN 2 AND 80 AND NOT regexp_full_match({0}, '\\d{{4}}') AND NOT regexp_full_match(lower({0}), '\\d+(st|nd|rd|th) place') AND lower({0}) NOT IN (" + ", ".join(f"'{w}'" for w in NOISE_TERMS) + f", {STOP}) AND regexp_matches({{0}}, '[A-Za-z0-9!]')"
_INITIALS = "upper(list_aggregate(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9!]+'), lambda w: left(w, 1)), 'string_agg', ''))"
_ACRONYM = f"(CASE WHEN len(regexp_extract_all({{0}}, '[A-Za-z][A-Za-z0-9!]+')) BETWEEN 2 AND 6 AND lower({_INITIALS}) NOT IN ({STOP}) THEN {_INITIALS} END)"
_PLURAL = "(CASE WHEN regexp_full_match({0}, '[A-Za-z0-9 ]+') AND NOT ends_with(lower({0}), 's') AND length({0}) >= 4 THEN {0} || 's' END)"
TERM_ALIASES = rf"""
WITH r AS (SELECT p_name AS raw, 'part' AS source FROM part UNION ALL SELECT n_name, 'nation' FROM nation UNION ALL SELECT r_name, 'region' FROM region UNION ALL SELECT p_type, 'type' FROM part),
t AS (SELECT trim(regexp_replace(translate(raw, '_-', '  '), '\s+', ' ', 'g')) AS canonical, source FROM r),
a AS (SELECT DISTINCT canonical, source, unnest([canonical, {_PLURAL.format('canonical')}, {_ACRONYM.format('canonical')}]) AS alias FROM t WHERE canonical <> ''),
n AS (SELECT lower(canonical) AS key, min(canonical) AS canonical FROM a GROUP BY 1),
s AS (SELECT key, string_agg(alias, '|' ORDER BY lower(alias), alias) AS aliases, count(*) AS n FROM (SELECT DISTINCT lower(canonical) AS key, alias FROM a WHERE alias IS NOT NULL) WHERE {_USEFUL.format('alias')} GROUP BY 1),
o AS (SELECT key, string_agg(source, '|' ORDER BY source) AS sources FROM (SELECT DISTINCT lower(canonical) AS key, source FROM a) GROUP BY 1)
SELECT canonical, aliases, sources, round(least(4.0, 1.0 + n / 10), 6) AS score FROM n JOIN s USING (key) JOIN o USING (key) WHERE {_USEFUL.format('canonical')}
"""


def acronyms(spark: SparkSession, d: str) -> DataFrame:
    term = normalize_term(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", term.alias("term"), acronym(term).alias("acronym"), plural_alias(term).alias("plural"))


ACRONYMS = rf"WITH t AS (SELECT p_partkey, trim(regexp_replace(translate(p_name, '_-', '  '), '\s+', ' ', 'g')) AS term FROM part) SELECT p_partkey, term, {_ACRONYM.format('term')} AS acronym, {_PLURAL.format('term')} AS plural FROM t"


def detected(spark: SparkSession, d: str) -> DataFrame:
    """Titles of pages as entities in the passages."""
    titles = pages_of(table(spark, d, "documents")).select(F.col("title").alias("raw"), F.col("page_id").alias("source"), F.col("title").alias("hint"))
    known = materialized(terms.merge_terms(terms.add_terms(titles)))
    return detect_entities(questions(table(spark, d, "benchmark")), known).select("query_id", "canonical", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """A balanced sample of 100 documents over the sources."""
    rows = table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("ordinal"))
    return entities.select_chunks(rows, 100).select(F.col("document_id").alias("source"), F.col("ordinal").alias("doc_id"))


ROUND_ROBIN = """
WITH t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS first FROM documents)
SELECT source, doc_id FROM t ORDER BY turn, first LIMIT 100
"""


def best_events(spark: SparkSession, d: str) -> DataFrame:
    """The highest value of each user and type, the first of equals."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("canonical_guess"), F.lit("event").alias("label"), F.col("user_id").alias("document_id"), F.col("value").alias("score"), F.col("event_id").alias("ord"))
    return entities.best_candidates(rows).select(F.col("canonical_guess").alias("event_type"), F.col("document_id").alias("user_id"), F.col("ord").alias("event_id"))


BEST_EVENTS = "SELECT event_type, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY lower(event_type), user_id ORDER BY value DESC NULLS LAST, event_id) = 1"


def merged_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as mentions: by type, the most valuable stands for the group and those after it are merged."""
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("canonical_key"), F.lit("event").alias("label"), F.pmod("user_id", F.lit(50)).cast("string").alias("group_id"), F.col("event_type").alias("canonical"), F.lit("review").alias("decision"), F.lit("").alias("decision_reason"),
        F.round("value", 3).alias("confidence"), F.lit("").alias("target_page_id"), F.lit("").alias("target_title"), F.lit("").alias("link_reason"), F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("chunk_id"),
        F.col("event_type").alias("name"), F.lit("").alias("context"), F.array("event_type").alias("own_aliases"), F.col("event_id").alias("ord"),
    )
    out = entities.merge_after_winner(rows, ["canonical_key", "label", "group_id"])
    return out.select("canonical_key", F.col("source_chunk_id").alias("winner"), F.col("source_document_id").alias("winner_user"), "mentions", F.array_join("source_document_ids", ",").alias("users"))


MERGED_EVENTS = """
WITH e AS (SELECT event_type AS canonical_key, user_id % 50 AS g, round(value, 3) AS conf, event_id, user_id FROM events),
w AS (SELECT canonical_key, g, arg_min(event_id, (-conf, event_id)) AS winner, arg_min(user_id, (-conf, event_id)) AS winner_user FROM e GROUP BY 1, 2),
m AS (SELECT canonical_key, g, winner, winner_user::VARCHAR AS winner_user, count(*) AS mentions FROM e JOIN w USING (canonical_key, g) WHERE event_id >= winner GROUP BY ALL),
u AS (SELECT canonical_key, g, string_agg(user_id, ',' ORDER BY user_id) AS users FROM (SELECT DISTINCT canonical_key, g, user_id::VARCHAR AS user_id FROM e JOIN w USING (canonical_key, g) WHERE event_id >= winner) GROUP BY 1, 2)
SELECT canonical_key, winner, winner_user, mentions, users FROM m JOIN u USING (canonical_key, g)
"""


def key_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Names of nations, parts' types and their plurals, resolved against pages of nations, regions and parts."""
    nation, region, part = (table(spark, d, t) for t in ("nation", "region", "part"))
    pages = (
        nation.select(F.concat(F.lit("Nation/"), F.col("n_name")).alias("page_id"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("long").alias("ordinal"))
        .unionByName(region.select(F.concat(F.lit("Region/"), F.col("r_name")).alias("page_id"), F.col("r_name").alias("title"), (F.col("r_regionkey") + 1000).cast("long").alias("ordinal")))
        .unionByName(part.select(F.concat(F.lit("Part/"), F.col("p_partkey").cast("string")).alias("page_id"), F.col("p_name").alias("title"), (F.col("p_partkey") + 10000).alias("ordinal")))
    )
    index = entities.document_index(pages)
    asked = nation.select(F.lower("n_name").alias("name"), F.lit("Region/ASIA").alias("document_id")).union(part.select("p_name", F.concat(F.lit("Part/"), F.col("p_partkey").cast("string")))).union(part.select(F.concat("p_type", F.lit("s")), F.lit("")))
    asked = asked.groupBy("name", "document_id").agg(F.count(F.lit(1)).alias("times"))  # parts of one type ask the same
    return entities.resolve_targets(asked, index).groupBy("name", "document_id", "target_page_id", "target_title", "link_reason").agg(F.sum("times").alias("n"))


_ENTITY_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9!+]+', ' ', 'g'))"
_SINGULAR = "(CASE WHEN ends_with({0}, 'ies') AND length({0}) > 4 THEN left({0}, length({0}) - 3) || 'y' WHEN ends_with({0}, 's') AND NOT ends_with({0}, 'ss') AND length({0}) > 4 THEN left({0}, length({0}) - 1) ELSE {0} END)"
KEY_CASCADE = f"""
WITH pages AS (SELECT 'Nation/' || n_name AS page_id, n_name AS title, n_nationkey::BIGINT AS ordinal FROM nation UNION ALL SELECT 'Region/' || r_name, r_name, r_regionkey + 1000 FROM region UNION ALL SELECT 'Part/' || p_partkey, p_name, p_partkey + 10000 FROM part),
kp AS (SELECT *, {_ENTITY_KEY.format('title')} AS t, {_ENTITY_KEY.format("regexp_extract(page_id, '([^/]*)$', 1)")} AS l, {_ENTITY_KEY.format('page_id')} AS f, {_ENTITY_KEY.format(_ACRONYM.format('title'))} AS a FROM pages),
keys AS (SELECT DISTINCT key, page_id, ordinal FROM (SELECT page_id, ordinal, unnest([t, {_SINGULAR.format('t')}, l, {_SINGULAR.format('l')}, f, a]) AS key FROM kp) WHERE key <> ''),
by_key AS (SELECT key, count(DISTINCT page_id) AS n, arg_min(page_id, ordinal) AS first_page FROM keys GROUP BY 1),
asked AS (SELECT lower(n_name) AS name, 'Region/ASIA' AS document_id FROM nation UNION ALL SELECT p_name, 'Part/' || p_partkey FROM part UNION ALL SELECT p_type || 's', '' FROM part),
ks AS (SELECT name, document_id, {_ENTITY_KEY.format('name')} AS k FROM asked),
s AS (SELECT *, {_SINGULAR.format('k')} AS sk FROM ks),
j AS (SELECT s.*, o.title AS own_title, o.t AS tk, {_SINGULAR.format('o.t')} AS tsk, {_ENTITY_KEY.format("regexp_extract(document_id, '([^/]*)$', 1)")} AS tail,
  b1.n AS n1, b1.first_page AS f1, b2.n AS n2, b2.first_page AS f2, EXISTS (SELECT 1 FROM keys x WHERE x.key = k AND x.page_id = document_id) AS own1, EXISTS (SELECT 1 FROM keys x WHERE x.key = sk AND x.page_id = document_id) AS own2
  FROM s LEFT JOIN kp o ON o.page_id = document_id LEFT JOIN by_key b1 ON b1.key = k LEFT JOIN by_key b2 ON b2.key = sk),
r AS (SELECT *, CASE WHEN own_title IS NOT NULL AND (k = tk OR sk = tsk) THEN 'source_title' WHEN n1 = 1 THEN 'global_title' WHEN own1 THEN 'ambiguous_source_title' WHEN n1 > 1 THEN 'ambiguous_global_title'
  WHEN n2 = 1 THEN 'global_title' WHEN own2 THEN 'ambiguous_source_title' WHEN n2 > 1 THEN 'ambiguous_global_title' WHEN own_title IS NOT NULL AND k IN (tail, tsk) THEN 'source_path_tail' ELSE 'unlinked' END AS link_reason,
  CASE WHEN own_title IS NOT NULL AND (k = tk OR sk = tsk) THEN document_id WHEN n1 = 1 THEN f1 WHEN own1 THEN document_id WHEN n1 > 1 THEN f1 WHEN n2 = 1 THEN f2 WHEN own2 THEN document_id WHEN n2 > 1 THEN f2
  WHEN own_title IS NOT NULL AND k IN (tail, tsk) THEN document_id ELSE '' END AS target_page_id FROM j)
SELECT name, document_id, r.target_page_id, coalesce(pages.title, '') AS target_title, link_reason, count(*) AS n FROM r LEFT JOIN pages ON pages.page_id = r.target_page_id GROUP BY ALL
"""


def stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return reports.histograms(docs, {"source": F.col("source"), "lang": F.col("lang"), "size": F.floor(F.log2(F.length("text") + 1))}, F.col("doc_id")).select("name", "value", "n")


STATS = """
SELECT 'source' AS name, coalesce(nullif(source, ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'lang', coalesce(nullif(lang, ''), 'unknown'), count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'size', coalesce(floor(log2(length(text) + 1))::BIGINT::VARCHAR, 'unknown'), count(*) FROM documents GROUP BY 2
"""


def validation(spark: SparkSession, d: str) -> DataFrame:
    """All rules over texts as chunks; texts that an earlier document has are repeats."""
    rows = table(spark, d, "documents").select(F.md5("text").alias("chunk_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"), "text", F.col("lang").alias("url"), F.when(F.col("n_chars") > 100, "section").alias("chunk_type"))
    return reports.validate_chunks(rows).groupBy("severity", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("identifier").alias("identifiers"))


VALIDATION = rf"""
WITH c AS (SELECT md5(text) AS id, source, doc_id, text, lang, CASE WHEN n_chars > 100 THEN 'section' END AS kind FROM documents),
i AS (SELECT 'error' AS severity, 'empty_chunk_text' AS kind, id FROM c WHERE {strip("coalesce(text, '')")} = ''
UNION ALL SELECT 'warning', 'missing_chunk_url', id FROM c WHERE trim(coalesce(lang, '')) = ''
UNION ALL SELECT 'warning', 'missing_chunk_type', id FROM c WHERE kind IS NULL
UNION ALL SELECT 'warning', 'large_chunk', id FROM c WHERE length(text) > 9000
UNION ALL (SELECT 'error', 'duplicate_chunk_id', id FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) > 1)
UNION ALL SELECT 'info', 'many_chunks_per_document', source FROM c GROUP BY source HAVING count(*) > 500)
SELECT severity, kind, count(*) AS n, count(DISTINCT id) AS identifiers FROM i GROUP BY 1, 2
"""


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("key"))
    return reports.repeats(rows, "key", "doc_id").select("doc_id")


DUPLICATES = "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1"


def largest(spark: SparkSession, d: str) -> DataFrame:
    top = reports.largest(table(spark, d, "documents").select("doc_id", "source", "text"), F.length("text"), "doc_id")
    return top.select("doc_id", "source", F.col("size").cast("long").alias("n_chars"), F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).cast("long").alias("n_words"))


LARGEST = "SELECT doc_id, source, length(text) AS n_chars, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n_words FROM documents ORDER BY length(text) DESC, doc_id LIMIT 20"


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", indexing.stable_point_id(F.concat_ws("::", F.col("source"), F.col("doc_id").cast("string"), "lang")).alias("point_id"))


POINT_IDS = f"""
WITH h AS (SELECT doc_id, sha1(from_hex('{indexing.URL_NAMESPACE}') || encode(concat_ws('::', source, doc_id, lang))) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h
"""


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = pages_of(table(spark, d, "documents"))
    chunks = pages.select("document_id", "title", F.array("title").alias("heading_path"), "tags", F.lit("wiki").alias("source_type"), F.lit("article").alias("chunk_type"), "domain", "subculture", F.col("series_primary").alias("series"), F.col("sections")[0]["text"].alias("text"))
    return chunks.select("document_id", F.md5(indexing.embedding_text(chunks)).alias("text_md5"))


EMBEDDING_TEXTS = f"""
WITH p AS (SELECT {PAGE} AS document_id, {TITLE} AS title, lang, source, coalesce(text, '') AS text FROM documents)
SELECT document_id, md5(array_to_string(list_filter(['Title: ' || title, 'Headings: ' || title, 'Tags: ' || lang || ', ' || source, 'Source: wiki', 'Document: ' || document_id, 'Chunk type: article', 'Domain: ' || lang, 'Subculture: general', 'Series: ', text],
  lambda x: regexp_matches(x, '\\S')), chr(10))) AS text_md5 FROM p
"""


def newest_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("version", F.struct("ts", "event_id"))
    return indexing.latest(rows, "user_id", "version").select("user_id", "event_id", "event_type")


NEWEST_EVENTS = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the late ones taken in again under new states: rows of one key are replaced, new keys are added."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), "o_orderstatus", "o_totalprice")
    again = orders.filter("o_totalprice > 200000").withColumn("o_orderstatus", F.lit("X")).unionByName(orders.filter("o_totalprice < 5000").withColumn("point_id", -F.col("point_id") - 1))
    return indexing.upsert(orders, again).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("least"), F.max("point_id").alias("most"))


UPSERTED = """
WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey - 1, o_orderstatus FROM orders WHERE o_totalprice < 5000)
SELECT o_orderstatus, count(*) AS n, min(id) AS least, max(id) AS most FROM o GROUP BY 1
"""


def areas(spark: SparkSession, d: str) -> DataFrame:
    """Domains and areas of part types as paths."""
    path = F.lower(F.concat(F.element_at(F.array(F.lit("Client"), F.lit("Modding"), F.lit("Rules"), F.lit("News"), F.lit("Ranking")), (F.col("p_size") % 5 + 1).cast("int")), F.lit("/"), F.col("p_type"), F.lit("/en.md")))
    rows = table(spark, d, "part").select(path.alias("path"))
    topic = F.split_part("path", F.lit("/"), F.lit(1))
    return rows.select(taxonomy.domain_of(F.col("path")).alias("domain"), taxonomy.area_of_path(F.col("path"), topic).alias("area")).groupBy("domain", "area").agg(F.count(F.lit(1)).alias("n"))


AREAS = """
WITH t AS (SELECT lower(['Client', 'Modding', 'Rules', 'News', 'Ranking'][p_size % 5 + 1]) AS domain FROM part)
SELECT domain, CASE domain WHEN 'client' THEN 'client' WHEN 'modding' THEN 'mapping' WHEN 'rules' THEN 'moderation' WHEN 'ranking' THEN 'gameplay' ELSE 'general' END AS area, count(*) AS n FROM t GROUP BY 1, 2
"""


def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"))
    pages = table(spark, d, "pages").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("url").alias("urls"))
    turns = table(spark, d, "conversations").agg(F.count_distinct("conv_id").alias("conversations"), F.count(F.lit(1)).alias("turns"))
    return docs.crossJoin(pages).crossJoin(turns)


INGEST_REPORT = "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT sum(length(text))::BIGINT FROM documents) AS chars, (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT url) FROM pages) AS urls, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT count(*) FROM conversations) AS turns"


def chunk_validation(spark: SparkSession, d: str) -> DataFrame:
    """The validator over all chunks of all documents, of a size that it finds large."""
    made = build_chunks(pages_of(table(spark, d, "documents")), LARGE_CHUNKS)
    return reports.validate_chunks(made).groupBy("severity", "kind").agg(F.count(F.lit(1)).alias("n"))


CHUNK_VALIDATION = f"""
WITH {packed_parts(LARGE_CHUNKS - 300)}, c AS (SELECT *, {TITLE} AS title FROM p),
t AS (SELECT unnest(list_transform(parts, lambda x: length({SECTION_HEADER} || x))) AS n FROM c)
SELECT 'warning' AS severity, 'large_chunk' AS kind, count(*) AS n FROM t WHERE n > 9000 HAVING count(*) > 0
"""


QUERIES = {
    "alias_group_mode": (alias_candidates, ALIAS_CANDIDATES),
    "term_aliases": (term_aliases, TERM_ALIASES),
    "acronyms_plurals": (acronyms, ACRONYMS),
    "entity_detect_greedy": (detected, None),
    "round_robin_sample": (round_robin, ROUND_ROBIN),
    "best_per_key_dedupe": (best_events, BEST_EVENTS),
    "merge_after_winner": (merged_events, MERGED_EVENTS),
    "key_cascade_link": (key_cascade, KEY_CASCADE),
    "stats_grouping_sets": (stats, STATS),
    "validation_rules": (validation, VALIDATION),
    "chunk_validation": (chunk_validation, CHUNK_VALIDATION),
    "duplicate_ids": (duplicates, DUPLICATES),
    "top20_largest": (largest, LARGEST),
    "uuid5_point_id": (point_ids, POINT_IDS),
    "embedding_text": (embedding_texts, EMBEDDING_TEXTS),
    "latest_version": (newest_events, NEWEST_EVENTS),
    "upsert_points": (upserted, UPSERTED),
    "area_taxonomy": (areas, AREAS),
    "ingest_report": (ingest_report, INGEST_REPORT),
}
