"""URL filters: prefix rules, then a blocked Bloom filter of listed canonical URLs and an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import cut, let

#: (verdict, host, path); a rule fits its host, all subdomains, and urls whose path starts with its path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Sites of this query's list, blocked where no rule fits: a site's root stands for it and its subdomains.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = tuple(f"{name}.example.{top}/" for name in LISTED_NAMES for top in ("com", "net", "org"))
#: The query lists pages of the table too, one in sixteen: those whose canonical url has an MD5 that begins so.
LISTED_MD5 = "0"

#: The filter: blocks of eight 64-bit words, a key sets one bit in each word of its block.
WORDS = 8
KEYS_PER_BLOCK = 32
#: Odd multipliers that draw the eight bits from one hash: fixed values, those of Parquet's split-block filters.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: The filter is broadcast up to this many bytes; a larger one is joined by block.
BROADCAST_BYTES = 32 << 20


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty where the url is null or has no ``://``.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end; the path from there to ``?``, ``#``
    or the end.
    """
    text = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(text, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, shape, 2)


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Rules keyed by host and path; of equal keys, block wins."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    return table.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))


def n_labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def host_suffixes(host: Column, most: Column | int) -> Column:
    """The host and its parents at dots, those of at most ``most`` labels: of a.b.c and 2 these are b.c and c."""
    below = lambda labels: F.sequence(F.greatest(F.lit(1), F.size(labels) - most + 1), F.size(labels))
    return let(F.split(host, r"\."), lambda labels: F.transform(below(labels), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def fitting_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each row of ``pages(row_id, host, path)``: row_id, rule, verdict.

    A url's candidates are its host's suffixes, as deep as some rule's host is, each with the prefixes of its path that
    are as long as some rule's path; they are looked up in the rules by an equi-join. Distinct path lengths are few
    however many rules there are. Of rules that are equally long the longer host wins.
    """
    lengths = rules.select(F.length("rule_path").alias("n"), n_labels(F.col("rule_host")).alias("labels")).distinct().agg(F.sort_array(F.collect_set("n")).alias("lengths"), F.coalesce(F.max("labels"), F.lit(0)).alias("deepest"))
    keyed = pages.crossJoin(F.broadcast(lengths)).select(
        "row_id",
        F.explode(host_suffixes(F.col("host"), F.col("deepest"))).alias("rule_host"),
        F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda n: n <= F.length("path")).alias("lengths"),
        "path",
    )
    tried = keyed.select("row_id", "rule_host", F.explode("lengths").alias("n"), "path").select("row_id", "rule_host", F.expr("left(path, n)").alias("rule_path"))
    hits = tried.join(rules, ["rule_host", "rule_path"])
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"), "rule_host", "rule_path", "verdict")
    best = hits.groupBy("row_id").agg(F.max(rank).alias("best"))
    return best.select("row_id", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def page_key(host: Column, path: Column) -> Column:
    """The canonical url of a page: no port, no ``www.`` or ``m.``, no repeated or last slash, no ``.html``; null without a host."""
    page = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"(?:/index)?\.html?$|/$", "")
    own = F.concat(F.regexp_replace(site_name(host), r"^(?:www|m)\.", ""), F.when(page == "", "/").otherwise(page))
    return F.when(host != "", own)


def site_name(host: Column) -> Column:
    return F.regexp_replace(host, r":\d*$", "")


def canonical_keys(host: Column, path: Column, most: int) -> Column:
    """Keys under which a url may be listed: its page, and the roots of its site and of the sites above it, of up to ``most`` labels."""
    roots = F.transform(host_suffixes(site_name(host), most), lambda h: F.concat(h, F.lit("/")))
    return F.when(host != "", F.array_distinct(F.array_append(roots, page_key(host, path)))).otherwise(F.array().cast("array<string>"))


def deepest_site(listed: DataFrame) -> int:
    """Labels of the deepest site root among ``listed(key)``; 0 without any."""
    return listed.filter(F.col("key").rlike("^[^/]*/$")).agg(F.coalesce(F.max(n_labels(F.col("key"))), F.lit(0))).first()[0]


def bit_masks(key: Column) -> list[Column]:
    """The key's bit in each word of its block: the top six of the low 32 bits of its hash times the word's multiplier."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(1), key), 33)
    tops = [F.shiftrightunsigned((draw * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 26).cast("int") for s in SALTS]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), t) for t in tops]


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(blocks))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``listed(key)`` as a blocked Bloom filter: block, w0 ... w7."""
    bits = listed.select(block_of(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(bit_masks(F.col("key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def listed_rows(keyed: DataFrame, listed: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """row_ids of ``keyed(row_id, key)`` with a key in ``listed(key)``.

    The Bloom filter lets possible hits pass and an exact join removes the false ones. The filter takes 72
    bytes a block; its size is known from the number of listed keys before it is built.
    """
    listed = listed.filter("key is not null").distinct()
    blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    bloom = bloom_filter(listed, blocks)
    if blocks * 72 <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    probed = keyed.withColumn("block", block_of(F.col("key"), blocks)).join(bloom, "block")
    passes = None
    for i, m in enumerate(bit_masks(F.col("key"))):
        hit = F.col(f"w{i}").bitwiseAND(m) != 0
        passes = hit if passes is None else passes & hit
    return probed.filter(passes).select("row_id", "key").join(listed, "key", "left_semi").select("row_id").distinct()


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: the id, host, path, rule, verdict, listed.

    Null urls, and urls without ``://``, have empty host and path, fit no rule and are allowed. Rows that
    share an id, or have none, are judged one by one; an empty table gives an empty result; further columns play no
    part. A host of very many labels has no more keys than the rules and the listed sites are deep.
    """
    host, path = url_parts(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    distinct = parts.select("host", "path").distinct().select(F.struct("host", "path").alias("row_id"), "host", "path")
    ruled = fitting_rule(distinct, rules)
    rest = distinct.join(ruled, "row_id", "left_anti")
    hits = listed_rows(rest.select("row_id", F.explode(canonical_keys(F.col("host"), F.col("path"), deepest_site(listed))).alias("key")), listed)
    judged = ruled.select("row_id", "rule", F.col("rule_verdict").alias("verdict"), F.lit(False).alias("listed")).union(
        hits.select("row_id", F.lit(None).cast("string"), F.lit("block"), F.lit(True))
    ).select(F.col("row_id.host").alias("_host"), F.col("row_id.path").alias("_path"), "rule", "verdict", "listed")
    return parts.join(judged, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed")
    )


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list: the fixed sites, and the canonical urls of one in sixteen of the table's pages."""
    sites = pages.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in LISTED])).alias("key"))
    own = pages.select(page_key(*url_parts("url")).alias("key")).distinct()
    return sites.union(own.filter(F.md5("key").startswith(LISTED_MD5)))


def op6(pages: DataFrame) -> DataFrame:
    return judge_urls(pages, rule_table(pages.sparkSession), cut(listed_urls(pages))).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    listed = ", ".join(f"('{x}')" for x in LISTED)
    return rf"""
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path, row_number() OVER () AS r FROM split
), rules(v, h, p) AS (VALUES {rules}
), fitted AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
), named AS (
  SELECT *, regexp_replace(host, ':\d*$', '') AS name, regexp_replace(regexp_replace(path, '/+', '/', 'g'), '(?:/index)?\.html?$|/$', '', 'g') AS page FROM parts
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(name, '^(?:www|m)\.', '') || (CASE WHEN page = '' THEN '/' ELSE page END) END AS own FROM named
), listed(k) AS (VALUES {listed} UNION SELECT own FROM keyed WHERE md5(own) LIKE '{LISTED_MD5}%'
), hits AS (
  SELECT r FROM keyed JOIN listed ON own = k
  UNION SELECT r FROM keyed JOIN (SELECT k FROM listed WHERE regexp_matches(k, '^[^/]*/$')) ON host <> '' AND (name || '/' = k OR ends_with(name || '/', '.' || k))
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN hits.r IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fitted USING (r) LEFT JOIN hits USING (r)
"""


SQL = _sql()
