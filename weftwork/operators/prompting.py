"""Prompts with numbered sources, and the interface to a language model."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import blank

REFUSAL = "The given context does not answer this question."
INSTRUCTIONS = (
    "Answer the question from the numbered context below and from nothing else.\n"
    "If the context is not enough, say so.\n"
    "Cite each statement with its sources in brackets, like [1] or [2]."
)


def build_prompts(queries: DataFrame, results: DataFrame, chunks: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """query_id and prompt of each question with results: instructions, question, results in order of rank."""
    facts = chunks.select("chunk_id", "heading_path", "url", "text", F.col("title").alias("_title"))
    heading = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise(F.col("_title"))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("_title"), F.lit(" | "), heading, F.lit("\nURL: "), F.col("url"), F.lit("\nText:\n"), F.col("text"))
    blocks = results.join(facts, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    context = F.array_join(F.col("b.block"), "\n\n---\n\n")
    return blocks.join(queries, "query_id").select("query_id", F.concat(F.lit(f"{instructions}\n\nQuestion: "), F.col("query"), F.lit("\n\nContext:\n"), context, F.lit("\n\nAnswer:")).alias("prompt"))


def http_generator(url: str, model: str, timeout_seconds: int = 120, temperature: float = 0.1) -> Callable[[str], str]:
    """A client of a model server that takes a prompt as JSON and gives its whole answer as ``response``."""

    def generate(prompt: str) -> str:
        body = json.dumps({"model": model, "prompt": prompt, "stream": False, "options": {"temperature": temperature}}).encode()
        asked = urllib.request.Request(f"{url}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(asked, timeout=timeout_seconds) as said:
            return str(json.load(said).get("response") or "").strip()

    return generate


def answer(queries: DataFrame, prompts: DataFrame, generate: Callable[[str], str]) -> DataFrame:
    """query_id and answer; questions without results, and empty answers, get the refusal.

    ``generate`` is called in Arrow batches on the executors; a client with a connection is made there once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"query_id": b["query_id"], "answer": [generate(p) for p in b["prompt"]]})

    kind = prompts.schema["query_id"].dataType.simpleString()
    said = prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string")
    return queries.select("query_id").join(said, "query_id", "left").select("query_id", F.when(blank(F.col("answer")), F.lit(REFUSAL)).otherwise(F.col("answer")).alias("answer"))
