"""URL filters: parts, rules, and the Bloom filter with the join behind it."""

from __future__ import annotations

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftwork.llm import urlfilter

PAGES = "page_id long, url string"


def parts(url: str | None) -> tuple[str, str]:
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1], found[2]) if found else ("", "")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def own_key(host: str, path: str) -> str:
    page = re.sub(r"(?:/index)?\.html?$|/$", "", re.sub("/+", "/", path))
    return re.sub(r"^(?:www|m)\.", "", re.sub(r":\d*$", "", host)) + (page or "/")


def brute(url: str | None):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    name = re.sub(r":\d*$", "", host)
    labels, own = name.split("."), own_key(host, path)
    keys = {".".join(labels[i:]) + "/" for i in range(max(0, len(labels) - 3), len(labels))} | {own}
    listed = bool(host) and (bool(keys & set(urlfilter.LISTED)) or hashlib.md5(own.encode()).hexdigest().startswith("0"))
    return host, path, None, "block" if listed else "allow"


URLS = [
    "https://Example.COM/en/7", "http://www.example.com/en/71?x=/de/", "https://com/en/", "https://com/en", "https://a.net/de/8", "https://example.net/de/8/x",
    "https://sub.example.net/de/8", "ftp://x.org/es/#y", "https://org/es", "no scheme /en/", "", None, "://", "https://", "https://ads-track.example.com", "https://www.ads-track.example.com/any/page.html",
    "https://ADS-TRACK.example.org:8080//a//b", "https://not-ads-track.example.org/", "x://y://com/en/", "https://notcom/en/", "https://m.spam-farm.example.net/index.html", "https://a.b.c.example.com/fr/7",
]


def check(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.op6(pages).collect()}
    assert out == {i: brute(u) for i, u in enumerate(urls)}


def test_planted(spark):
    check(spark, URLS)


def test_a_list_that_grows_with_the_pages(spark):
    """10,000 pages and more, one in sixteen of them listed: blocks of the filter, false positives, and what is listed."""
    check(spark, [f"https://Site{i % 900}.example.info/{i // 7}/p{i}.html" for i in range(12_000)])


def test_a_host_of_very_many_labels(spark):
    began = time.monotonic()
    check(spark, ["https://" + "a." * 20_000 + "com/en/x", "https://" + "b." * 20_000 + "spam-farm.example.net/x", "https://" + "." * 200_000 + "/y", "https://h/" + "/" * 200_000, "https://x" + ":1" * 100_000 + "/"])
    assert time.monotonic() - began < 30


def test_clashing_columns(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), PAGES)
    more = pages.select("*", *[F.lit("own").alias(c) for c in ("host", "path", "row_id", "rule", "verdict", "key", "block", "w0", "_host", "listed")])
    assert sorted(map(repr, urlfilter.op6(more).collect())) == sorted(map(repr, urlfilter.op6(pages).collect()))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="comnetrgx.:/?#endsEXAMPL78-", max_size=40), min_size=1, max_size=60))
def test_any_url(spark, urls):
    check(spark, [*urls, *(f"http://{u}" for u in urls)])


def test_repeated_and_missing_ids(spark):
    pages = spark.createDataFrame([(1, "https://a.org/es/1"), (1, "https://a.org/es/1"), (1, "https://b.xyz/"), (None, None)], PAGES)
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in urlfilter.op6(pages).collect()) == [(0, "allow"), (1, "allow"), (1, "block"), (1, "block")]
    assert urlfilter.op6(spark.createDataFrame([], PAGES)).collect() == []


def test_filter_lets_every_listed_key_pass_and_the_join_removes_the_rest(spark):
    listed = spark.range(2000).select(F.concat(F.lit("site"), F.col("id").cast("string"), F.lit(".org/")).alias("key"))
    asked = spark.range(6000).select(F.col("id").alias("row_id"), F.concat(F.lit("site"), F.col("id").cast("string"), F.lit(".org/")).alias("key"))
    for most in (urlfilter.BROADCAST_BYTES, 0):
        found = urlfilter.listed_rows(asked, listed, most)
        assert sorted(r["row_id"] for r in found.collect()) == list(range(2000))
    blocks = 63
    bloom = urlfilter.bloom_filter(listed, blocks)
    probed = asked.withColumn("block", urlfilter.block_of(F.col("key"), blocks)).join(bloom, "block")
    for i, m in enumerate(urlfilter.bit_masks(F.col("key"))):
        probed = probed.filter(F.col(f"w{i}").bitwiseAND(m) != 0)
    passed = {r["row_id"] for r in probed.select("row_id").collect()}
    assert set(range(2000)) <= passed and len(passed) < 2000 + 0.05 * 4000


def test_longest_rule_wins_and_no_rules(spark):
    none = urlfilter.rule_table(spark).limit(0)
    pages = spark.createDataFrame([(1, "https://a.com/en/1")], PAGES)
    listed = spark.createDataFrame([("a.com/en/1",)], "key string")
    assert urlfilter.judge_urls(pages, none, listed).first()["verdict"] == "block"
    assert urlfilter.judge_urls(pages, none, listed.limit(0)).first()["verdict"] == "allow"
    assert urlfilter.judge_urls(pages, urlfilter.rule_table(spark, (("block", "com", "/en/"), ("allow", "a.com", "/en/1"))), listed).first()["verdict"] == "allow"
