"""Files to tables to answers: readers, writers, settings, the index stream and the command line."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tests.test_structure import NEWS, WIKI
from weftwork import cli, jobs
from weftwork.operators import prompting
from weftwork.operators.indexing import embedding_text, stable_point_id
from weftwork.sources import files, sinks
from weftwork.sources.config import Config, load_config, load_vocabulary
from weftwork.storage import checkpoint_root
from weftwork.streaming.indexing import BUCKETS, index_stream
from weftwork.vocab import Vocabulary


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "my corpus"
    for name, text in {"wiki/Widget/en.md": WIKI, "wiki/Widget/de.md": "# Ding", "wiki/Two words+more/en.md": "# Two\r\n\r\nwords", "news/2024/2024-05-06-day-out.md": NEWS}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return root


@pytest.fixture
def config(corpus, tmp_path):
    return load_config(None, {"WEFTWORK_CORPUS_PATH": str(corpus), "WEFTWORK_ARTIFACTS_PATH": str(tmp_path / "artifacts"), "WEFTWORK_EMBEDDING_DIMENSIONS": "32"})


def test_markdown_files(spark, corpus):
    found = {r["rel_path"]: r["text"] for r in files.markdown_files(spark, str(corpus)).collect()}
    assert set(found) == {"Widget/en.md", "Two words+more/en.md", "news/2024/2024-05-06-day-out.md"}
    assert found["Widget/en.md"] == WIKI
    with pytest.raises(FileNotFoundError):
        files.markdown_files(spark, str(corpus / "nowhere"))


def test_records(spark, tmp_path):
    path = str(tmp_path / "rows")
    assert sinks.write_records(spark.createDataFrame([("A", ["a"], ["s"], 1.0)], files.ENTITIES), path) == 1
    assert files.read_entities(spark, path).first()["aliases"] == ["a"]
    assert files.read_entities(spark, str(tmp_path / "none")).count() == 0


def test_examples(spark, tmp_path):
    path = tmp_path / "questions.jsonl"
    path.write_text(json.dumps({"question": " what? ", "expected_document_ids": ["A"]}) + "\n\n" + json.dumps({"question": "who?", "category": "c"}) + "\n")
    rows = {r["query"]: r for r in files.read_examples(spark, str(path)).collect()}
    assert rows["what?"]["category"] == "uncategorized" and rows["what?"]["expected_document_ids"] == ["A"] and rows["who?"]["expected_chunk_ids"] == []
    path.write_text(json.dumps({"question": " "}) + "\n")
    with pytest.raises(ValueError, match="no question"):
        files.read_examples(spark, str(path))
    with pytest.raises(FileNotFoundError):
        files.read_examples(spark, str(tmp_path / "none"))


def test_settings(tmp_path):
    path = tmp_path / "settings.toml"
    path.write_text('[retrieval]\nfinal_top_k = 3\n[generation]\nurl = "http://x/"\n')
    config = load_config(str(path), {"WEFTWORK_RETRIEVAL_DENSE_TOP_K": "5", "WEFTWORK_ARTIFACTS_SOURCE_PATH": "/shared"})
    assert (config.retrieval.final_top_k, config.retrieval.dense_top_k, config.generation.url) == (3, 5, "http://x")
    assert config.artifacts.reads("chunks") == "/shared/chunks" and config.artifacts.writes("chunks") == "artifacts/chunks"
    assert load_config(None, {}) == Config()
    path.write_text("[retrieval]\nother = 1\n")
    with pytest.raises(ValueError, match="other"):
        load_config(str(path), {})


def test_vocabulary(tmp_path):
    path = tmp_path / "settings.toml"
    path.write_text('[vocabulary]\nhosts = ["a.org"]\nseed_terms = ["x y"]\nlabel_rules = [[["client", "app"], "software"]]\n[vocabulary.manual_targets]\nxy = "X/Y"\n')
    vocab = load_vocabulary(str(path))
    assert (vocab.hosts, vocab.seed_terms, vocab.label_rules, vocab.manual_targets) == (("a.org",), ("x y",), ((("client", "app"), "software"),), {"xy": "X/Y"})
    assert load_config(str(path), {}) == Config() and load_vocabulary() == Vocabulary()
    path.write_text("[vocabulary]\nother = 1\n")
    with pytest.raises(ValueError, match="other"):
        load_vocabulary(str(path))


def test_http_generator():
    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = json.dumps({"response": f" {asked['model']}: {asked['prompt']} {asked['stream']} {asked['options']['temperature']} "}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.handle_request, daemon=True).start()
    assert prompting.http_generator(f"http://127.0.0.1:{server.server_port}", "m", 5, 0.2)("why?") == "m: why? False 0.2"
    server.server_close()


def test_point_ids(spark):
    names = ["a", "Ranking::section::é", "x" * 300]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", stable_point_id(F.col("n")).alias("id")).collect()
    assert all(r["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in rows)


CHUNK = "chunk_id string, chunk_index int, title string, heading_path array<string>, tags array<string>, source_type string, document_id string, chunk_type string, domain string, subculture string, series string, text string"


def chunk(i, text):
    return (f"c{i}", i, "T", ["T", "S"], ["t"], "wiki", f"D{i}", "section", "d", "s", None, text)


def test_embedding_text(spark):
    rows = spark.createDataFrame([chunk(1, "body")], CHUNK)
    assert rows.select(embedding_text(rows)).first()[0] == "Title: T\nHeadings: T > S\nTags: t\nSource: wiki\nDocument: D1\nChunk type: section\nDomain: d\nSubculture: s\nSeries: \nbody"


def test_index_stream_resumes_and_replaces(spark, tmp_path):
    checkpoint_root(spark)
    chunks, index, states = (str(tmp_path / n) for n in ("chunks", "index", "states"))
    spark.createDataFrame([chunk(i, f"text {i}") for i in range(5)], CHUNK).repartition(3).write.parquet(chunks)
    index_stream(spark, chunks, index, states, files_per_batch=1)
    first = {r["point_id"]: r for r in spark.read.parquet(index).collect()}
    assert len(first) == 5 and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-5 and 0 <= r["bucket"] < BUCKETS for r in first.values())
    spark.createDataFrame([chunk(1, "changed"), chunk(9, "new")], CHUNK).write.mode("append").parquet(chunks)
    index_stream(spark, chunks, index, states)
    second = {r["payload"]["chunk_id"]: r["payload"]["text"] for r in spark.read.parquet(index).collect()}
    assert second == {"c0": "text 0", "c1": "changed", "c2": "text 2", "c3": "text 3", "c4": "text 4", "c9": "new"}
    index_stream(spark, chunks, index, str(tmp_path / "over"))  # all over again: the same points
    assert spark.read.parquet(index).count() == 6


def test_whole_run(spark, config, tmp_path):
    report = jobs.ingest(spark, config)
    assert report["documents"] == 3 and report["wiki_documents"] == 2 and report["chunks"] > 3
    assert jobs.build_terms(spark, config)["entities"] > 0
    assert jobs.build_links(spark, config)["raw_links"] >= 4
    jobs.extract_entities(spark, config, "dictionary", {"names": {"Bolt": "feature"}})
    assert jobs.normalize_entities(spark, config)["normalized_rows"] >= 1
    made = jobs.stats(spark, config)
    assert made["histograms"].filter("name = 'source' and value = 'wiki'").first()["n"] == 2
    assert {"news_year", "news_series", "chunk_type"} <= {r["name"] for r in made["histograms"].collect()}
    total = made["totals"].first()
    assert total["documents"] == 3 and total["chunks"] == report["chunks"] and total["entities"] > 0 and total["aliases"] >= total["entities"]
    assert [r["chars"] for r in made["largest_chunks"].collect()] == sorted((r["chars"] for r in made["largest_chunks"].collect()), reverse=True)
    assert made["largest_alias_sets"].count() > 0
    assert jobs.validate(spark, config).filter("kind = 'duplicate_chunk_id'").count() == 0
    assert jobs.build_index(spark, config)["points"] == report["chunks"] == jobs.build_index(spark, config)["points"]
    apart = replace(config, artifacts=replace(config.artifacts, path=str(tmp_path / "other"), source_path=config.artifacts.path))
    assert jobs.build_index(spark, apart, limit=2)["points"] == 2 and jobs.build_index(spark, apart, offset=1, limit=2)["points"] == 3
    assert jobs.build_index(spark, apart, offset=3)["points"] == report["chunks"]
    asked = spark.createDataFrame([(0, "widget parts")], "query_id int, query string")
    for dense in (False, True):
        assert jobs.search(spark, config, asked, dense).filter("rank = 1").first()["document_id"] == "Widget"
    assert "widget parts" in jobs.prompts(spark, config, asked).first()["prompt"]
    path = tmp_path / "questions.jsonl"
    path.write_text(json.dumps({"question": "widget parts", "category": "c", "expected_document_ids": ["Widget"]}) + "\n")
    assert jobs.evaluate(spark, config, str(path), output=str(tmp_path / "judged")).filter("category is null").first()["retrieval_accuracy"] == 1.0
    row = spark.read.json(str(tmp_path / "judged")).first()
    assert row["question"] == "widget parts" and row["matched"] == 1 and [s["rank"] for s in row["top_sources"]] == list(range(1, len(row["top_sources"]) + 1))
    nobody = spark.createDataFrame([(0, "widget parts"), (1, "zzz")], "query_id int, query string")
    said = {r["query_id"]: r["answer"] for r in jobs.answers(spark, config, nobody, lambda prompt: "yes [1]" if "widget parts" in prompt else "").collect()}
    assert said == {0: "yes [1]", 1: prompting.REFUSAL}


def test_command_line(spark, config, capsys, monkeypatch):
    monkeypatch.setattr(cli, "load_config", lambda path: config)
    assert cli.main(["ingest"]) == 0 and json.loads(capsys.readouterr().out)["documents"] == 3
    assert cli.main(["inspect", "--keyword-only", "widget"]) == 0 and '"rank":1' in capsys.readouterr().out
    assert cli.main(["validate"]) == 0
    assert cli.main(["eval", "/nowhere"]) == 1 and "nowhere" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["unknown"])
