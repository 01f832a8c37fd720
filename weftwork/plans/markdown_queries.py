"""Queries about Markdown structure, on pages that are made from the tables' rows: front matter, headings, fences, tables, links, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import markdown as md
from weftwork.operators import structure
from weftwork.plans.tables import table
from weftwork.vocab import Vocabulary

SITE = Vocabulary(hosts=("example.com", "example.net"), base_url="https://example.com")
TICKS = "```"


def _text(*parts: str | F.Column) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def made_pages(spark: SparkSession, d: str) -> DataFrame:
    """rel_path and body of a page per part: headings of levels that its key decides, a fence and a pipe table."""
    key, size = F.col("p_partkey"), F.col("p_size")
    mark = lambda c: F.repeat(F.lit("#"), (c % 3 + 1).cast("int"))
    body = _text(
        "# ", F.col("p_name"), "\n\nkey ", key.cast("string"), "\n\n## A\n\n", mark(key), " B ", size.cast("string"), "\n\ntext of b\n\n", TICKS, "\n# not closed yet\nx = ", key.cast("string"), "\n", TICKS, "\n\n",
        mark(size), " C\n\n| name | size | note |\n| :-- | --: | :-: |\n| ", F.col("p_brand"), " | ", size.cast("string"), " | n |\n| ", F.col("p_type"), " | a\\|b |\n\n## A\n\nend\n",
    )
    return table(spark, d, "part").select(_text("part/", key.cast("string"), "/en.md").alias("rel_path"), body.alias("body"))


_BODY = f"""'# ' || p_name || chr(10) || chr(10) || 'key ' || p_partkey || chr(10) || chr(10) || '## A' || chr(10) || chr(10) || repeat('#', (p_partkey % 3 + 1)::INT) || ' B ' || p_size || chr(10) || chr(10) || 'text of b'
 || chr(10) || chr(10) || '{TICKS}' || chr(10) || '# not closed yet' || chr(10) || 'x = ' || p_partkey || chr(10) || '{TICKS}' || chr(10) || chr(10) || repeat('#', (p_size % 3 + 1)::INT) || ' C' || chr(10) || chr(10)
 || '| name | size | note |' || chr(10) || '| :-- | --: | :-: |' || chr(10) || '| ' || p_brand || ' | ' || p_size || ' | n |' || chr(10) || '| ' || p_type || ' | a' || chr(92) || '|b |' || chr(10) || chr(10) || '## A' || chr(10) || chr(10) || 'end' || chr(10)"""
_LINES = rf"""
WITH p AS (SELECT 'part/' || p_partkey || '/en.md' AS rel_path, {_BODY} AS body FROM part),
s AS (SELECT rel_path, string_split(body, chr(10)) AS ls FROM p),
l AS (SELECT rel_path, i AS n, ls[i] AS line FROM (SELECT rel_path, ls, unnest(range(1, len(ls))) AS i FROM s)),
f AS (SELECT *, starts_with(line, '{TICKS}') AS fence, (sum(starts_with(line, '{TICKS}')::INT) OVER (PARTITION BY rel_path ORDER BY n)) % 2 = 1 OR starts_with(line, '{TICKS}') AS fenced FROM l),
h AS (SELECT rel_path, n, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_extract(line, '^#+\s+(.*)$', 1)) AS title, row_number() OVER (PARTITION BY rel_path ORDER BY n) AS section FROM f WHERE regexp_matches(line, '^#{{1,6}}\s'))
"""


def fence_parity(spark: SparkSession, d: str) -> DataFrame:
    """Lines in and out of fences, per page."""
    lines = structure.page_lines(made_pages(spark, d))
    return lines.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("fence").alias("n_fences"), F.count_if("fenced").alias("n_fenced"))


FENCE_PARITY = _LINES + "SELECT rel_path, count(*) AS n_lines, count_if(fence)::BIGINT AS n_fences, count_if(fenced)::BIGINT AS n_fenced FROM f GROUP BY 1"


def heading_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Sections with ids, parents and heading paths; a heading in a fence counts, as it does in the structure."""
    heads = structure.section_heads(structure.section_lines(structure.page_lines(made_pages(spark, d))))
    return heads.select("rel_path", F.col("section").cast("long").alias("section"), "section_id", "parent_section_id", F.col("level").cast("long").alias("level"), F.array_join("heading_path", " > ").alias("heading_path"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


HEADING_HIERARCHY = _LINES + r""",
slug AS (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9!_ -]+', '', 'g'), '\s+', '-', 'g'), '-') AS base FROM h),
ids AS (SELECT *, base || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS section_id FROM (SELECT *, row_number() OVER (PARTITION BY rel_path, base ORDER BY section) AS k FROM slug)),
up AS (SELECT a.rel_path, a.section, b.section AS above, b.section_id AS above_id, b.title AS above_title FROM ids a JOIN ids b ON a.rel_path = b.rel_path AND b.section < a.section AND b.level < a.level
  AND NOT EXISTS (SELECT 1 FROM ids c WHERE c.rel_path = a.rel_path AND c.section > b.section AND c.section < a.section AND c.level <= b.level)),
paths AS (SELECT rel_path, section, string_agg(above_title, ' > ' ORDER BY above) AS above, arg_max(above_id, above) AS parent FROM up GROUP BY 1, 2),
last AS (SELECT rel_path, max(n) AS n FROM l GROUP BY 1)
SELECT ids.rel_path, section, section_id, parent AS parent_section_id, level, concat_ws(' > ', above, title) AS heading_path, ids.n AS start_line,
  greatest(ids.n, coalesce(lead(ids.n) OVER (PARTITION BY ids.rel_path ORDER BY section) - 1, last.n)) AS end_line
FROM ids JOIN last USING (rel_path) LEFT JOIN paths USING (rel_path, section)
"""


def pipe_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the pages' tables, padded to one width."""
    own = structure.content_lines(structure.section_lines(structure.page_lines(made_pages(spark, d))))
    tables = structure.section_tables(structure.table_marks(own))
    return tables.select("rel_path", F.array_join("t.headers", ";").alias("headers"), F.array_join("t.alignments", ";").alias("alignments"), F.posexplode("t.rows").alias("row", "cells")).select("rel_path", "headers", "alignments", F.col("row").cast("long").alias("row"), F.array_join("cells", ";").alias("cells"))


PIPE_TABLE_ROWS = """
SELECT 'part/' || p_partkey || '/en.md' AS rel_path, 'name;size;note' AS headers, 'left;right;center' AS alignments, r AS row, CASE r WHEN 0 THEN trim(p_brand) || ';' || p_size || ';n' ELSE trim(p_type) || ';a|b;' END AS cells
FROM part, (VALUES (0::BIGINT), (1::BIGINT)) v(r)
"""


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Entries of front matter that is made of customers: quoted values, a list, a key that is given twice."""
    text = _text("---\nname: \"", F.col("c_name"), "\"\ntags:\n  - ", F.col("c_mktsegment"), "\n  - n", F.col("c_nationkey").cast("string"), "\nkey: first\nkey: k", F.col("c_custkey").cast("string"), "\n---\n# Title\n")
    rows = table(spark, d, "customer").select("c_custkey", md.front_matter(text).alias("m"), md.body_of(text).alias("body"))
    return rows.select("c_custkey", md.matter_value(F.col("m"), "name").alias("name"), F.array_join(md.matter_list(F.col("m"), "tags"), ",").alias("tags"), md.matter_value(F.col("m"), "key").alias("key"), md.title_of(F.col("body"), F.lit("none")).alias("title"))


FRONT_MATTER = "SELECT c_custkey, c_name AS name, c_mktsegment || ',n' || c_nationkey AS tags, 'k' || c_custkey AS key, 'Title' AS title FROM customer"


def link_kinds(spark: SparkSession, d: str) -> DataFrame:
    """All pages' addresses as link targets, by kind."""
    to = md.classify_link(F.col("url"), F.lit("Start"), F.lit("Start/en.md"), SITE)
    rows = table(spark, d, "pages").select("page_id", to.alias("to"))
    return rows.select("page_id", "to.link_type", "to.target_page_id")


_HOST = "lower(regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
LINK_KINDS = f"""
WITH u AS (SELECT page_id, trim(url) AS t FROM pages)
SELECT page_id, CASE WHEN coalesce(t, '') = '' THEN 'other' WHEN {_HOST} IN ('example.com', 'example.net') THEN 'site_internal' ELSE 'external' END AS link_type, NULL::VARCHAR AS target_page_id FROM u
"""


def news_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates in the three formats of news, with offsets."""
    day = F.date_format("o_orderdate", "yyyy-M-d")
    raw = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, _text(day, " 7:05:00")).otherwise(_text(day, " 07:05:00 +0200"))
    return table(spark, d, "orders").select("o_orderkey", md.news_date(raw).alias("date_iso"))


NEWS_DATES = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderkey % 3 WHEN 0 THEN 'T00:00:00' WHEN 1 THEN 'T07:05:00' ELSE 'T07:05:00+02:00' END AS date_iso FROM orders"


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages, parsed and put together again: counts of what they hold."""
    docs = structure.parse_pages(made_pages(spark, d).select("rel_path", F.col("body").alias("text")), SITE)
    return docs.select("page_id", "title", *[F.col(c).cast("long").alias(c) for c in ("section_count", "edge_count", "citation_count", "table_count", "formula_count")])


PAGE_DOCUMENTS = "SELECT 'part/' || p_partkey AS page_id, trim(p_name) AS title, 6::BIGINT AS section_count, 0::BIGINT AS edge_count, 0::BIGINT AS citation_count, 1::BIGINT AS table_count, 0::BIGINT AS formula_count FROM part"

def full_pages(spark: SparkSession, d: str) -> DataFrame:
    """rel_path and text of a page per supplier, with all kinds of links, images, formulas, footnotes, a comment and a fence."""
    k = F.col("s_suppkey").cast("string")
    text = _text(
        "# ", F.col("s_name"), "\n\n<!-- gone [x](/wiki/Gone) -->See [part ", k, "](/wiki/Part/", k, "_(x)#Top_B), [own](#B-", k, "), [home](https://example.com/home), [far](https://other.test/a_(b)), [mail](mailto:a@b.c), ",
        "[file](/wiki/shared/f.png), [near](../../nation/", F.col("s_nationkey").cast("string"), "/en.md), [none](), [ref ", k, "][R1] and https://bare.test/", k, ", then:\n\n", TICKS, "\n[hidden](/wiki/Hidden)\nx = ", k, " + 1\n", TICKS,
        '\n\n![alt](/wiki/shared/p.png "On top") ![alt](/wiki/shared/p.png "On top") ![far][r2]\n\n## B ', k, "\n\nThe weight `w = ", k, " * 2` counts.[^n1] And `plain` does not.[^n2]",
        F.when(F.col("s_suppkey") % 2 == 0, _text(" ![no](/x) [twice](/wiki/Even/", k, ")")).otherwise(""), "\n\n[r1]: /wiki/Other#Part\n[r2]: https://img.test/i.png\n[^n1]: Note **", k, "**.\n",
    )
    return table(spark, d, "supplier").select(_text("supplier/", k, "/en.md").alias("rel_path"), text.alias("text"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of whole pages: inline with balanced targets, by reference, bare; of all seven kinds."""
    edges = structure.parse_pages(full_pages(spark, d), SITE).select("page_id", F.posexplode("link_edges").alias("at", "e"))
    return edges.select("page_id", (F.col("at") + 1).cast("long").alias("nth"), *[f"e.{c}" for c in ("edge_id", "link_text", "url_raw", "url_resolved", "link_type", "target_page_id", "target_anchor", "is_reference_link")])


PAGE_LINKS = """
WITH p AS (SELECT s_suppkey::VARCHAR AS k, s_nationkey::VARCHAR AS n, 'supplier/' || s_suppkey AS page_id, s_suppkey % 2 = 0 AS even,
  regexp_replace(lower(s_name), '[^a-z0-9!_ -]+', '', 'g') AS slug FROM supplier),
e AS (SELECT page_id, slug, 'b-' || k AS slug_b, unnest([
  {nth: 1, part: 1, txt: 'part ' || k, raw: '/wiki/Part/' || k || '_(x)#Top_B', url: '/wiki/Part/' || k || '_(x)#top_b', kind: 'wiki_section', page: 'Part/' || k || '_(x)', anchor: 'top_b', ref: false},
  {nth: 2, part: 1, txt: 'own', raw: '#B-' || k, url: '/wiki/' || page_id || '#b-' || k, kind: 'wiki_section', page: page_id, anchor: 'b-' || k, ref: false},
  {nth: 3, part: 1, txt: 'home', raw: 'https://example.com/home', url: 'https://example.com/home', kind: 'site_internal', page: NULL, anchor: NULL, ref: false},
  {nth: 4, part: 1, txt: 'far', raw: 'https://other.test/a_(b)', url: 'https://other.test/a_(b)', kind: 'external', page: NULL, anchor: NULL, ref: false},
  {nth: 5, part: 1, txt: 'mail', raw: 'mailto:a@b.c', url: 'mailto:a@b.c', kind: 'mailto', page: NULL, anchor: NULL, ref: false},
  {nth: 6, part: 1, txt: 'file', raw: '/wiki/shared/f.png', url: '/wiki/shared/f.png', kind: 'wiki_asset', page: NULL, anchor: NULL, ref: false},
  {nth: 7, part: 1, txt: 'near', raw: '../../nation/' || n || '/en.md', url: '/wiki/nation/' || n, kind: 'wiki_article', page: 'nation/' || n, anchor: NULL, ref: false},
  {nth: 8, part: 1, txt: 'none', raw: '', url: NULL, kind: 'other', page: NULL, anchor: NULL, ref: false},
  {nth: 9, part: 1, txt: 'ref ' || k, raw: '/wiki/Other#Part', url: '/wiki/Other#part', kind: 'wiki_section', page: 'Other', anchor: 'part', ref: true},
  {nth: 10, part: 1, txt: 'https://bare.test/' || k, raw: 'https://bare.test/' || k, url: 'https://bare.test/' || k, kind: 'external', page: NULL, anchor: NULL, ref: false},
  {nth: 11, part: 2, txt: 'twice', raw: '/wiki/Even/' || k, url: '/wiki/Even/' || k, kind: 'wiki_article', page: 'Even/' || k, anchor: NULL, ref: false}]) AS e, even FROM p)
SELECT page_id, e.nth::BIGINT AS nth, CASE e.part WHEN 1 THEN slug || ':' || e.nth ELSE slug_b || ':1' END AS edge_id, e.txt AS link_text, e.raw AS url_raw, e.url AS url_resolved, e.kind AS link_type, e.page AS target_page_id, e.anchor AS target_anchor, e.ref AS is_reference_link
FROM e WHERE e.nth < 11 OR even
"""


def page_contents(spark: SparkSession, d: str) -> DataFrame:
    """What whole pages hold besides their links: images, formulas, citations, comments that are gone."""
    docs = structure.parse_pages(full_pages(spark, d), SITE)
    of = lambda field: F.array_join(F.flatten(F.transform("sections", lambda s: s[field])), "|")
    images = F.array_join(F.transform(F.flatten(F.transform("sections", lambda s: s["images"])), lambda i: F.concat_ws(",", i["alt"], i["title"], i["url_resolved"], i["link_type"])), "|")
    formulas = F.array_join(F.transform(F.flatten(F.transform("sections", lambda s: s["formulae"])), lambda f: F.concat_ws(":", f["source"], f["expression"])), "|")
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["citation_id"], c["text"], c["missing_definition"].cast("string"), F.array_join(c["referenced_in_sections"], ","))), "|")
    counts = [F.col(c).cast("long").alias(c) for c in ("section_count", "edge_count", "citation_count", "image_count", "formula_count")]
    return docs.select("page_id", *counts, of("citation_refs").alias("citation_refs"), images.alias("images"), formulas.alias("formulas"), cited.alias("citations"), F.contains(F.array_join(F.transform("sections", lambda s: s["text"]), " "), F.lit("gone")).alias("comment_left"))


PAGE_CONTENTS = """
SELECT 'supplier/' || s_suppkey AS page_id, 2::BIGINT AS section_count, (CASE WHEN s_suppkey % 2 = 0 THEN 11 ELSE 10 END)::BIGINT AS edge_count, 2::BIGINT AS citation_count, 2::BIGINT AS image_count,
  3::BIGINT AS formula_count, 'n1|n2' AS citation_refs, 'alt,On top,/wiki/shared/p.png,wiki_asset|far,,https://img.test/i.png,external' AS images,
  'code_block:[hidden](/wiki/Hidden)|code_block:x = ' || s_suppkey || ' + 1|inline_code:w = ' || s_suppkey || ' * 2' AS formulas,
  'n1:Note **' || s_suppkey || '**.:false:b-' || s_suppkey || '|n2::true:b-' || s_suppkey AS citations, false AS comment_left
FROM supplier
"""

QUERIES = {
    "fence_parity": (fence_parity, FENCE_PARITY),
    "heading_hierarchy": (heading_hierarchy, HEADING_HIERARCHY),
    "pipe_table_rows": (pipe_table_rows, PIPE_TABLE_ROWS),
    "frontmatter_parse": (front_matter, FRONT_MATTER),
    "link_classify": (link_kinds, LINK_KINDS),
    "news_dates": (news_dates, NEWS_DATES),
    "page_documents": (page_documents, PAGE_DOCUMENTS),
    "page_links": (page_links, PAGE_LINKS),
    "page_contents": (page_contents, PAGE_CONTENTS),
}
