"""Co-training: accuracy on labels it has not seen, and every odd table."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, clashing, empty_docs, odd_docs, rows_of
from weftwork.llm import cotraining
from weftwork.llm.common import documents, shared_path

TESTDATA = "/root/testdata"
TABLES = f"{TESTDATA}/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def features_of(spark, docs):
    return cotraining.write_features(docs, shared_path(spark, "test-features"))


def accuracy(spark, features, model, unseen):
    told = cotraining.score(features, model).join(unseen.select(F.col("doc_id").cast("string").alias("doc_id"), "quality"), "doc_id").toPandas()
    good, bad = told[told["quality"] == 1], told[told["quality"] == 0]
    # how often it is right, how often the larger class would be, how often a good document outranks a bad one
    ranks = (good["score"].to_numpy()[:, None] > bad["score"].to_numpy()[None, :]).mean()
    return (told["kept"] == (told["quality"] == 1)).mean(), max(len(good), len(bad)) / len(told), ranks


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_rounds(spark, sf):
    """Held-out accuracy with rounds and without; in each round both views give rows of both classes."""
    docs, labels = documents(spark, f"{TESTDATA}/{sf}"), spark.read.parquet(f"{TESTDATA}/{sf}/labels.parquet")
    side = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3))
    seen, unseen = labels.filter(side > 0), labels.filter(side == 0)
    features = features_of(spark, docs)
    (plain, none), (one, _), (model, told) = (cotraining.co_train(features, seen, rounds=k) for k in range(3))
    assert none == [] and len(told) == 2
    for rows in told:
        assert set(rows["kind"]) == {0, 1, 2, 3} and rows.groupby("kind").size().max() <= 1.3 * cotraining.EXCHANGED
        assert not rows.duplicated(["kind", "content"]).any() and rows["weight"].between(0, 0.5).all()
        assert not set(rows["doc_id"]) & {str(r["doc_id"]) for r in seen.collect()}
    for a, b in ((plain, one), (one, model)):  # every round changes both views
        assert np.abs(a.text - b.text).max() > 1e-3 and np.abs(a.meta - b.meta).max() > 1e-3
    right, larger, ranks = accuracy(spark, features, model, unseen)
    right_before, _, ranks_before = accuracy(spark, features, plain, unseen)
    print(sf, right, ranks, "without rounds", right_before, ranks_before, "larger class", larger)
    assert right > max(0.75, larger) and ranks > 0.8
    assert right >= right_before - 0.02 and ranks >= ranks_before - 0.02


def test_a_view_that_knows_teaches_the_other(spark):
    """Labels on texts of two words alone; the metadata tell the rest, so that the text view learns other words."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        good = i % 2
        words = [rng.choice(("fine", "clear") if good else ("spam", "junk"))] if i < 200 else [rng.choice(("calm", "plain") if good else ("wild", "loud"))]
        rows.append((i, " ".join(words * 3 + [f"w{rng.randrange(300)}" for _ in range(20)]), "en", f"site{good}", 100))
        if i < 200:
            labels.append((i, good, 0))
    features = features_of(spark, spark.createDataFrame(rows, SCHEMA))
    truth = spark.createDataFrame([(i, i % 2, 0) for i in range(200, 3000)], LABELS)
    seen = spark.createDataFrame(labels, LABELS)
    before, after = (cotraining.co_train(features, seen, rounds=k)[0] for k in (0, 2))
    text_alone = lambda model: cotraining.score(features, model).join(truth.select(F.col("doc_id").cast("string").alias("doc_id"), "quality"), "doc_id").filter((F.col("text_score") >= 0.5) == (F.col("quality") == 1)).count() / 2800
    assert text_alone(before) < 0.7 and text_alone(after) > 0.9


def test_reruns_agree(spark):
    docs, labels = documents(spark, TABLES), spark.read.parquet(f"{TABLES}/labels.parquet")
    a, b = (cotraining.co_train(features_of(spark, d), labels, rounds=1)[0] for d in (docs, docs.repartition(7)))
    assert np.allclose(a.text, b.text, atol=1e-5) and np.allclose(a.meta, b.meta, atol=1e-5)


def test_scores_are_those_of_plain_arithmetic(spark):
    docs, labels = odd_docs(spark).unionByName(documents(spark, TABLES).select("doc_id", "text", "lang", "source", "n_chars").limit(50)), spark.read.parquet(f"{TABLES}/labels.parquet")
    features = features_of(spark, docs)
    model, _ = cotraining.co_train(features, labels, rounds=1)
    tables = cotraining.class_table(), cotraining.lookup_table()
    expected = []
    for r in docs.collect():
        at, by = cotraining.text_features(r["text"] or "", *tables)
        t = (sum(float(model.text[i]) * float(v) for i, v in zip(at, by, strict=True)) + model.text[-1]) * model.text_scale[0] + model.text_scale[1]
        m = (sum(float(model.meta[i]) for i in cotraining.meta_features(r["source"], r["lang"], r["n_chars"])) + model.meta[-1]) * model.meta_scale[0] + model.meta_scale[1]
        expected.append((str(r["doc_id"]), round(float(model.both(t, m)), 5)))
    got = [(str(r["doc_id"]), round(r["score"], 5)) for r in cotraining.score(features, model).collect()]
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-4 for a, b in zip(sorted(got), sorted(expected), strict=True))


def test_clashing_columns(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (6, 1, 0), (5, 0, 0)], LABELS)
    assert rows_of(cotraining.op3(clashing(odd_docs(spark)), labels)) == rows_of(cotraining.op3(odd_docs(spark), labels))


def test_odd_tables(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (5, 0, 0), (6, 1, 0), (99, 1, 0), (None, 1, 0), (7, None, 1), (9, 0, 0), (9, 1, 0)], LABELS)
    scores = cotraining.op3(docs, labels).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    none = cotraining.op3(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in none} == {0.5}
    one_class = cotraining.op3(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)).collect()
    assert len({r["score"] for r in one_class}) == 1 and one_class[0]["score"] > 0.5
    assert cotraining.op3(empty_docs(spark), labels).collect() == []
