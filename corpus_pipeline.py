"""From raw documents to packed token sequences: five stages, each one operator over all that the last one kept.

All stages take null and empty texts, null and repeated ids, repeated rows, further columns of any names and empty tables;
an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftwork.llm import exactdedup, mixing, neardedup, packing, quality
from weftwork.llm.common import delete, documents, scratch, shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the language references reject go.

    Null and empty texts have no words and go. A null language is a language of its own; repeated rows stay or go together.
    """
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, the one with the largest doc_id stays.

    A null text is an empty one; a null doc_id is smaller than any other, and of rows that tie one stays.
    """
    return exactdedup.drop_exact_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest doc_id stays.

    Texts without words are like each other alone, and one of them stays; a null doc_id comes before all others, and of rows
    that tie one stays.
    """
    return neardedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says.

    A null source is a source of its own; a text without words has size 0 and is as often as its source's rate says; rows
    of one doc_id, or of none, are drawn apart by their texts. A source without any words is left out.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and its place there.

    A null or empty text is one piece, its end id alone; repeated rows are packed as often as they occur.
    """
    return packing.op2(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Fingerprints, components and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read by the next.

    A stage's table is deleted when the next one is written, and a stage's own tables with it; the last stage reads its
    input at once.
    """
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        kept = shared_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(kept)
        if last is not None:
            delete(spark, last)
        docs, last = spark.read.parquet(kept), kept
    packed = STAGES[-1][1](spark, docs, sf_dir)
    delete(spark, last)
    return packed
