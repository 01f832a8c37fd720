"""Index points: stable ids, embedding texts, payloads and idempotent upserts into a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import blank

#: Namespace of URLs for version-5 identifiers.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def stable_point_id(value: Column) -> Column:
    """The version-5 UUID of a string in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(value, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def embedding_text(c: DataFrame) -> Column:
    """A header of named metadata and the text, a line each, blank lines left out."""
    named = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    lines = F.array(
        named("Title", c["title"]),
        F.when(F.size(c["heading_path"]) > 0, named("Headings", F.array_join(c["heading_path"], " > "))).otherwise(""),
        F.when(F.size(c["tags"]) > 0, named("Tags", F.array_join(c["tags"], ", "))).otherwise(""),
        named("Source", c["source_type"]),
        named("Document", c["document_id"]),
        named("Chunk type", c["chunk_type"]),
        named("Domain", c["domain"]),
        named("Subculture", c["subculture"]),
        named("Series", c["series"]),
        F.coalesce(c["text"], F.lit("")),
    )
    return F.array_join(F.filter(lines, lambda x: ~blank(x)), "\n")


def index_points(chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """point_id, chunk_id, embedding_text, the chunk's fields as payload, and its vector if there are any."""
    points = chunks.select(stable_point_id(F.col("chunk_id")).alias("point_id"), embedding_text(chunks).alias("embedding_text"), *chunks.columns)
    return points if vectors is None else points.join(vectors, "chunk_id", "left")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key, by one aggregation with partial maxima; whole rows travel as a struct."""
    newest = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("*"), F.struct(version)).alias("_row"))
    return newest.select("_row.*")


def upsert(existing: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """``existing`` with rows replaced by those of ``new`` that have the same key; of repeats in ``new`` one stays."""
    one = new.dropDuplicates([key])
    return existing.join(one.select(key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def last_by_id(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Of rows with one id the last in order."""
    order = Window.partitionBy(key).orderBy(F.desc(ordinal))
    return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
