"""The index over time: changes, filters, progress, order; extraction from SQL."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_jobs import CHUNK, chunk
from weftwork import jobs
from weftwork.operators import bitmaps, entities, extraction, ordering, reports, snapshots
from weftwork.sources import files, sinks
from weftwork.sources.config import load_config
from weftwork.storage import checkpoint_root
from weftwork.streaming.indexing import index_stream, live_points, sync_into
from weftwork.vocab import Vocabulary

STATE = "key string, content string"


def test_changes(spark):
    old = [("a", "1"), ("b", "1"), ("c", "1"), (None, "1"), ("r", "1"), ("r", "2"), ("s", "1"), ("s", "1"), ("e", None)]
    new = [("a", "1"), ("b", "2"), ("d", "1"), (None, "2"), ("r", "2"), ("r", "1"), ("s", "1"), ("e", None)]
    found = snapshots.changes(spark.createDataFrame(old, STATE), spark.createDataFrame(new, STATE))
    assert {(r["key"], r["change"]) for r in found.collect()} == {("b", "update"), ("c", "delete"), ("d", "insert"), (None, "update"), ("s", "update")}
    empty = spark.createDataFrame([], STATE)
    assert snapshots.changes(empty, empty).collect() == []
    row = spark.createDataFrame([(1, None, "x"), (1, "x", None)], "a int, b string, c string")
    assert row.select(snapshots.content_of("a", "b", "c").alias("h")).distinct().count() == 2


def written(index: str) -> dict[str, float]:
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(index) for f in names if f.endswith(".parquet")}


def test_sync(spark, tmp_path):
    index = str(tmp_path / "index")
    first = spark.createDataFrame([chunk(i, f"text {i}") for i in range(20)], CHUNK)
    assert sync_into(first, index) == {"insert": 20, "update": 0, "delete": 0}
    before = written(index)
    assert sync_into(first.repartition(5), index) == {"insert": 0, "update": 0, "delete": 0} and written(index) == before
    later = spark.createDataFrame([chunk(i, f"text {i}" if i != 3 else "changed") for i in range(19)] + [chunk(30, "new")], CHUNK)
    assert sync_into(later, index) == {"insert": 1, "update": 1, "delete": 1}
    kept = {r["payload"]["chunk_id"]: r["payload"]["text"] for r in live_points(spark.read.parquet(index)).collect()}
    assert kept == {f"c{i}": f"text {i}" for i in range(19)} | {"c3": "changed", "c30": "new"}
    assert len(set(before) & set(written(index))) >= len(before) - 3  # other buckets stay as they are
    assert sync_into(first, index) == {"insert": 1, "update": 1, "delete": 1}
    assert sync_into(first.limit(0), index)["delete"] == 20 and live_points(spark.read.parquet(index)).count() == 0


def test_events_of_the_stream(spark, tmp_path):
    checkpoint_root(spark)
    chunks, told = str(tmp_path / "chunks"), []
    spark.createDataFrame([chunk(i, f"text {i}") for i in range(6)], CHUNK).repartition(3).write.parquet(chunks)
    events = index_stream(spark, chunks, str(tmp_path / "index"), str(tmp_path / "states"), files_per_batch=2, tell=told.append)
    assert events == told and [e["batch"] for e in events] == list(range(len(events))) and len(events) == 2
    assert events[-1]["total_rows"] == sum(e["rows"] for e in events) == 6 and all(e["seconds"] > 0 for e in events)
    assert index_stream(spark, chunks, str(tmp_path / "index"), str(tmp_path / "states")) == []


def test_guards(spark, tmp_path):
    config = load_config(None, {"WEFTWORK_ARTIFACTS_PATH": str(tmp_path)})
    with pytest.raises(FileNotFoundError):
        jobs.build_index(spark, config)
    spark.createDataFrame([chunk(i, f"text {i}") for i in range(3)], CHUNK).write.parquet(config.artifacts.writes("chunks"))
    for options, said in (({"limit": 0}, "limit"), ({"limit": -1}, "limit"), ({"offset": 3}, "past"), ({"files_per_batch": 0}, "batch"), ({"sync": True, "limit": 1}, "sync")):
        with pytest.raises(ValueError, match=said):
            jobs.build_index(spark, config, **options)
    report = jobs.build_index(spark, config, offset=-5, sync=True)
    assert (report["points"], report["inserts"], report["deletes"]) == (3, 3, 0)


def test_bitmaps(spark):
    rows = [(i, f"g{i % 3}" if i % 7 else None, i % 5) for i in range(70_000)]
    df = spark.createDataFrame(rows, "at long, g string, n int").repartition(3)
    index = bitmaps.bitmap_index(df, "at", ["g", "n"])
    for wanted in ({"g": ["g1"]}, {"g": ["g0", None], "n": [1, 3]}, {"g": ["nothing"]}, {"n": [0], "g": ["g2"]}, {}):
        found = {r["at"] for r in bitmaps.filtered(df, "at", bitmaps.selected(index, wanted)).collect()}
        assert found == {at for at, g, n in rows if g in wanted.get("g", [g]) and n in wanted.get("n", [n])}
    assert index.filter("field = 'g'").select("bucket").distinct().count() == 4  # position 0 is in a bucket of its own
    assert bitmaps.bitmap_index(df.limit(0), "at", ["g"]).collect() == []


def test_extraction_in_sql(spark):
    texts = [("d1", "c1", "Bolt and nut, BOLT"), ("d1", "c2", None), ("d2", "c3", "A nut. Bolts."), (None, "c4", "bolt"), ("d3", "c5", "")]
    df = spark.createDataFrame(texts, "document_id string, chunk_id string, text string")
    df.createOrReplaceTempView("some_texts")
    extraction.register(spark)
    found = spark.sql("SELECT * FROM extract_entities(TABLE(some_texts), map('Bolt', 'part', 'nut', 'part'))")
    assert sorted((r["chunk_id"], r["at"], r["text"], r["start"], r["end"]) for r in found.collect()) == [("c1", 0, "Bolt", 0, 4), ("c1", 1, "nut", 9, 12), ("c1", 2, "BOLT", 14, 18), ("c3", 0, "nut", 2, 5), ("c4", 0, "bolt", 0, 4)]
    chunks = df.select("*", F.lit("wiki").alias("source_type"), F.lit("T").alias("title"), F.array().cast("array<string>").alias("heading_path"), F.struct("document_id", "chunk_id").alias("ordinal"))
    best = entities.extract_entities(chunks.filter("text is not null"), "dictionary", {"names": {"Bolt": "part", "nut": "part"}}, ["part"], Vocabulary())
    keys = lambda rows: {(r["document_id"], r["text"].lower(), r["label"]) for r in rows}
    assert keys(best.collect()) == keys(found.collect())
    for call in ("extract_entities(TABLE(SELECT 1 AS x), map('a', 'b'))", "extract_entities(TABLE(some_texts), 'a')"):
        with pytest.raises(PySparkException, match="extract_entities"):
            spark.sql(f"SELECT * FROM {call}").collect()


@pytest.mark.parametrize("partitions", ["1", "3", "7"])
def test_order_of_files_and_numbers(spark, tmp_path, partitions):
    rows = [((i * 7919) % 1000 // 4, f"k{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "x int, k string").repartition(4)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        sinks.write_records(ordering.in_ranges(df, F.desc("x"), "k"), str(tmp_path / "out"))
        numbers = {(r["x"], r["k"]): r["nth"] for r in ordering.numbered(df, F.desc("x"), "k").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    lines = [json.loads(line) for f in sorted((tmp_path / "out").glob("*.json")) for line in f.read_text().splitlines()]
    assert [(r["x"], r["k"]) for r in lines] == want
    assert numbers == {r: i for i, r in enumerate(want, 1)}


def test_blank_question_is_named_by_its_line(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"question": "a"}\n\n{"question": "  "}\n{"category": "c"}\n')
    with pytest.raises(ValueError, match=r"line 3 in .*q\.jsonl; line 4 in"):
        files.read_examples(spark, str(path))


def test_one_year_lists_its_folder_alone(spark, tmp_path):
    for name in ("wiki/A/en.md", "news/2023/a.md", "news/2024/b.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# x")
    found = files.markdown_files(spark, str(tmp_path), year="2024")
    assert [r["rel_path"] for r in found.collect()] == ["news/2024/b.md"] and len(found.inputFiles()) == 1
    with pytest.raises(FileNotFoundError, match="2030"):
        files.markdown_files(spark, str(tmp_path), year="2030")


def test_validation_report_names_fifty_kinds(spark):
    rows = [("warning" if i % 2 else "error", f"kind{i:02}") for i in range(60) for _ in range(60 - i)]
    report = reports.validation_report(spark.createDataFrame(rows, "severity string, kind string")).first()
    assert report["issues"] == len(rows) and [(r["value"], r["n"]) for r in report["by_kind"]] == [(f"kind{i:02}", 60 - i) for i in range(50)]
    assert {r["value"]: r["n"] for r in report["by_severity"]} == {"error": 930, "warning": 900}
    assert reports.validation_report(spark.createDataFrame([], "severity string, kind string")).first()["issues"] == 0
