"""Quality rules against plain Python."""

from __future__ import annotations

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.helpers import clashing, empty_docs, odd_docs, rows_of, words
from weftwork.llm import quality
from weftwork.llm.common import documents


def brute_repeats(found: list, window: int = 8) -> int:
    grams = [tuple(found[i : i + window]) for i in range(len(found) - window + 1)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(window)}
    return len(covered)


def brute_base(text: str | None) -> tuple:
    found = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), brute_repeats(found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=60))
def test_repeated_words(found):
    assert quality.repeated_words([w.encode() for w in found]) == brute_repeats(found)


def test_base_counts(spark):
    for docs in (documents(spark, SMALL), odd_docs(spark)):
        texts = docs.select("doc_id", "text").collect()
        expected = sorted(((r["doc_id"], *brute_base(r["text"])) for r in texts), key=repr)
        out = quality.op1(docs)
        assert rows_of(out.select("doc_id", *quality.BASE)) == expected
        for r in out.collect():
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])


def test_js_distance(spark):
    def brute(p, q):
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b, strict=True) if x > 0)
        return np.sqrt((kl(p, (p + q) / 2) + kl(q, (p + q) / 2)) / 2)

    pairs = [([1, 2, 3], [3, 2, 1]), ([5, 0, 0], [0, 0, 7]), ([4, 4, 2], [2, 2, 1])]
    df = spark.createDataFrame(pairs, "p array<long>, q array<long>")
    for r in df.select("p", "q", quality.js_distance(F.col("p"), F.col("q")).alias("d")).collect():
        assert abs(r["d"] - brute(r["p"], r["q"])) < 1e-6
    none = spark.createDataFrame([([0, 0], [1, 1])], "p array<long>, q array<long>")
    assert none.select(quality.js_distance(F.col("p"), F.col("q"))).first()[0] is None


def test_far_from_its_language_goes_and_short_texts_are_guarded(spark):
    normal = documents(spark, SMALL).filter("lang = 'en' and length(text) > 400").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(-1, " ".join(f"{i * 7919 % 100000:05d}|{i}" for i in range(300)), "en", "z", 0), (-2, " ".join(f"{i}|{i + 1}" for i in range(25)), "en", "z", 0)]
    out = {r["doc_id"]: r for r in quality.op1(normal.unionByName(spark.createDataFrame(odd, normal.schema))).filter("doc_id < 0").collect()}
    assert not out[-1]["base_failed"] and not out[-1]["kept"]  # numbers are no English
    assert out[-2]["kept"]  # too short for its histograms to say anything


def test_each_distance_rejects_what_the_other_keeps(spark):
    normal = documents(spark, SMALL).filter("lang = 'en'").select("doc_id", "text", "lang", "source", "n_chars")
    prose = normal.filter("length(text) > 3000").first()["text"].split()
    marked = " ".join(w + "$%&*" * (i % 2) if w.lower() in quality.COMMON_WORDS["en"] else w for i, w in enumerate(prose[:500]))  # common words as ever, signs behind them
    marked = " ".join(w.replace("$%&*", " $%&*$%&*$%&*") for w in marked.split())
    other = " ".join("tree" if w.lower().strip(".,") in quality.COMMON_WORDS["en"] else w for w in prose[:500])  # letters as ever, no common words
    odd = [(-1, marked, "en", "z", 0), (-2, other, "en", "z", 0)]
    rows = quality.counted(normal.unionByName(spark.createDataFrame(odd, normal.schema)))
    references = quality.cut(quality.fit_references(rows))
    limit = references.filter("ref_lang = 'en'").first()
    out = {r["doc_id"]: r for r in quality.judged(rows, references).filter("doc_id < 0").collect()}
    words = lambda i: max(quality.WORD_FLOOR, limit["word_limit"] / out[i]["counts"]["n_words"] ** 0.5)
    assert not out[-1]["base_failed"] and not out[-2]["base_failed"] and not out[-1]["kept"] and not out[-2]["kept"]
    assert out[-1]["char_distance"] > limit["char_limit"] and out[-1]["word_distance"] <= words(-1)
    assert out[-2]["char_distance"] <= limit["char_limit"] and out[-2]["word_distance"] > words(-2)


def test_classes_are_those_of_unicode():
    table, names = quality.class_table(), list(quality.CLASSES)
    assert [names[table[ord(c)]] for c in "aÉ日5٣ \u00a0\t.«$😀\x00ß½"] == ["lower", "upper", "letter", "digit", "digit", "space", "space", "space", "punctuation", "punctuation", "symbol", "symbol", "control", "lower", "digit"]


def test_clean_documents_stay(spark):
    docs = documents(spark, SMALL)
    good = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id")
    judged = quality.op1(docs).join(good, "doc_id").filter("not base_failed")
    assert judged.filter("kept").count() >= 0.98 * judged.count()


def test_given_references(spark):
    docs = documents(spark, SMALL)
    references = quality.fit_references(quality.counted(docs))
    assert rows_of(quality.quality_rules(docs, references=references)) == rows_of(quality.quality_rules(docs))


def test_odd_tables(spark):
    assert quality.op1(empty_docs(spark)).collect() == []
    docs = odd_docs(spark)
    kept = quality.keep_good(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert quality.keep_good(empty_docs(spark)).count() == 0
    ids = sorted(r["doc_id"] for r in quality.op1(docs).filter("kept").collect())
    assert sorted(r["doc_id"] for r in kept.collect()) == ids


def test_one_long_text_does_not_make_a_reference_and_repeated_rows_are_judged_alike(spark):
    docs = documents(spark, SMALL).filter("lang = 'en'")
    rows = docs.unionByName(docs).unionByName(spark.createDataFrame([(-1, " ".join(str(i) for i in range(300_000)), "en", "z", 0)], docs.schema))
    before = {r["doc_id"] for r in quality.op1(docs).filter("kept").collect()}
    after = Counter(r["doc_id"] for r in quality.op1(rows).filter("kept").collect())
    assert len(set(after) ^ before) <= 0.03 * len(before) and set(after.values()) == {2}
