"""Command line: ``python -m weftwork.cli [--config FILE] COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork import jobs
from weftwork.operators.entities import MAX_TEXT_CHARS
from weftwork.operators.prompting import http_generator
from weftwork.sources.config import load_config, load_vocabulary


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftwork", description="Markdown corpora as tables: chunks, links, terms, search.")
    top.add_argument("--config", help="TOML file of settings")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("ingest", "terms", "links", "stats", "validate"):
        commands.add_parser(name)
    found = commands.add_parser("entities")
    found.add_argument("--backend", default="dictionary")
    found.add_argument("--names", required=True, help="JSON file of names and their labels")
    found.add_argument("--profile", default="default")
    found.add_argument("--limit", type=int)
    found.add_argument("--sampling", choices=("balanced", "sequential"), default="balanced")
    found.add_argument("--scoped", action="store_true")
    found.add_argument("--label", action="append", help="ask for this label, instead of the profile's; may repeat")
    found.add_argument("--model", help="model of the backend, if it has several")
    found.add_argument("--threshold", type=float, help="least score of a mention")
    found.add_argument("--max-text-chars", type=int, default=MAX_TEXT_CHARS)
    commands.add_parser("normalize-entities").add_argument("--full-merge", action="store_true")
    indexed = commands.add_parser("index")
    indexed.add_argument("--no-resume", dest="resume", action="store_false")
    indexed.add_argument("--offset", type=int, default=0)
    indexed.add_argument("--limit", type=int)
    indexed.add_argument("--sync", action="store_true", help="compare contents: take what is new or changed, drop what is gone")
    indexed.add_argument("--files-per-batch", type=int, default=64)
    indexed.add_argument("--quiet", action="store_true")
    for name in ("inspect", "query"):
        asked = commands.add_parser(name)
        asked.add_argument("question")
        asked.add_argument("--keyword-only", action="store_true")
    judged = commands.add_parser("eval")
    judged.add_argument("path")
    judged.add_argument("--dense", action="store_true")
    judged.add_argument("--output", help="folder of the questions' own rows, as JSON lines")
    return top


def say(what: dict | DataFrame) -> None:
    """A report as JSON; a small table, which the caller has cut down to what is shown, row by row."""
    if isinstance(what, dict):
        print(json.dumps(what, ensure_ascii=False, indent=2))
        return
    for row in what.toJSON().toLocalIterator():
        print(row)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    config, vocab = load_config(args.config), load_vocabulary(args.config)
    if args.command in ("ingest", "terms"):
        say({"ingest": jobs.ingest, "terms": jobs.build_terms}[args.command](spark, config, vocab))
    elif args.command == "links":
        say(jobs.build_links(spark, config))
    elif args.command == "entities":
        with open(args.names, encoding="utf-8") as f:
            options = {"names": json.load(f)} | {k: v for k, v in (("model", args.model), ("threshold", args.threshold)) if v is not None}
        say(jobs.extract_entities(spark, config, args.backend, options, args.profile, args.limit, args.sampling, args.scoped, vocab, args.label, args.max_text_chars))
    elif args.command == "normalize-entities":
        say(jobs.normalize_entities(spark, config, args.full_merge, vocab))
    elif args.command == "stats":
        made = jobs.stats(spark, config)
        say(made["totals"])
        say(made["histograms"].orderBy("name", F.desc("n"), "value"))
        say(made["largest_chunks"].orderBy(F.desc("chars"), "chunk_id"))
        say(made["largest_alias_sets"].orderBy(F.desc("alias_count"), "canonical"))
    elif args.command == "validate":
        issues = jobs.validate(spark, config)
        say(issues.groupBy("severity", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy("severity", "kind"))
        return int(not issues.filter("severity = 'error'").isEmpty())
    elif args.command == "index":
        tell = None if args.quiet else lambda event: print(json.dumps(event), flush=True)
        report = jobs.build_index(spark, config, args.resume, args.offset, args.limit, args.sync, args.files_per_batch, tell)
        if not args.quiet:
            say(report)
    elif args.command == "eval":
        say(jobs.evaluate(spark, config, args.path, args.dense, vocab, args.output).orderBy("category"))
    else:
        asked = spark.createDataFrame([(0, args.question)], "query_id int, query string")
        dense, to = not args.keyword_only, config.generation
        if args.command == "inspect":
            say(jobs.search(spark, config, asked, dense, vocab).orderBy("rank"))
        elif to.url:
            say(jobs.answers(spark, config, asked, http_generator(to.url, to.model, to.timeout_seconds, to.temperature), dense, vocab))
        else:  # no model to ask: what it would be asked
            say(jobs.prompts(spark, config, asked, dense, vocab))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftwork").getOrCreate()
    try:
        return run(spark, args)
    except (FileNotFoundError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
