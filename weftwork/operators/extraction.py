"""Extraction as a table function: ``SELECT * FROM extract_entities(TABLE(chunks), map('name', 'label', ...))``.

The table is dealt by document, in order of chunk, as the function itself asks for; rows go by one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from weftwork.operators.entities import create_extractor
from weftwork.storage import small_batches

COLUMNS = ("document_id", "chunk_id", "text")
MENTIONS = T.StructType().add("document_id", "string").add("chunk_id", "string").add("at", "integer").add("text", "string").add("label", "string").add("score", "double").add("start", "integer").add("end", "integer")


class ExtractEntities:
    """Raw mentions in the texts of a table with document_id, chunk_id and text, by a dictionary of names and labels.

    ``max_text_chars`` is how much of a text the backend sees; without it the whole. Other columns may be there; null texts have
    no mentions.
    """

    @staticmethod
    def analyze(chunks: AnalyzeArgument, names: AnalyzeArgument, max_text_chars: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not chunks.isTable:
            raise ValueError("extract_entities takes a table first")
        if missing := [c for c in COLUMNS if c not in chunks.dataType.names]:
            raise ValueError(f"the table of extract_entities has no {', '.join(missing)}")
        if not isinstance(names.dataType, T.MapType):
            raise ValueError("extract_entities takes a map of names and their labels")
        return AnalyzeResult(schema=MENTIONS, partitionBy=[PartitioningColumn("document_id")], orderBy=[OrderingColumn("chunk_id")])

    def __init__(self):
        self.extractor, self.labels = None, []

    def eval(self, row, names: dict[str, str], max_text_chars: int | None = None) -> Iterator[tuple]:
        if self.extractor is None:
            self.extractor, self.labels = create_extractor("dictionary", names=dict(names)), sorted(set(names.values()))
        text = row["text"] or ""
        for at, m in enumerate(self.extractor.extract(text if max_text_chars is None else text[:max_text_chars], self.labels)):
            yield row["document_id"], row["chunk_id"], at, m["text"], m["label"], float(m["score"]), m["start"], m["end"]


def register(spark: SparkSession, name: str = "extract_entities") -> None:
    """Make the function known to the session's SQL; its rows come in small Arrow batches."""
    small_batches(spark)
    spark.udtf.register(name, udtf(ExtractEntities, useArrow=True))


