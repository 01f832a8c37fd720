"""Ranked lexical search: byte impacts bound every document's score, exact integers decide among those that may win.

The index has two levels. The first holds a byte for each posting, its impact rounded up, whatever the term's weight: sums
of bytes times weights bound a score from above and from below. The second holds counts and lengths; scores are computed
from it, in integers, for every document whose upper bound reaches the k-th lower bound, and for no other.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.common import shared_path, texts_for_python, whole

#: A term is a run of ASCII letters and digits and of any characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 50
#: An impact is at most this, for a term that is all of an endlessly repeated text.
MOST = 1_000_000
#: What one step of a byte stands for: 255 of them reach MOST.
STEP = -(-MOST // 255)
#: Documents, and postings, of one shard of the index, about: what a task scores at a time.
SHARD_DOCS = 1 << 15
SHARD_POSTINGS = 1 << 21
#: Bytes of distinct query texts that are searched for in one pass over the documents, about.
BLOCK_BYTES = 16 << 20


def terms_table() -> bytes:
    """Bytes as terms have them: A-Z lowered, what parts terms as spaces."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes, table: bytes) -> list[bytes]:
    return text.translate(table).split()


def posted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n (its terms, repeats counted), terms (those of the vocabulary, by number), counts."""
    known, table = docs.sparkSession.sparkContext.broadcast(vocabulary), terms_table()
    rows = texts_for_python(docs).select(F.col(id_col).alias("doc_id"), whole(text_col).cast("binary").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column("text"):
                found = Counter(terms_of(text.as_py(), table))
                held = sorted((numbers[t], tf) for t, tf in found.items() if t in numbers)
                lengths.append(found.total())
                terms.append([t for t, _ in held])
                counts.append([tf for _, tf in held])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return rows.mapInArrow(post, schema)


def length_factors(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of ``n`` terms: 50 and 50 times how many times the mean length they are, rounded down."""
    most = int(n.max(initial=0))
    if 50 * most * documents < 1 << 63:
        return 50 + (50 * documents * n) // terms
    return np.array([50 + 50 * x * documents // terms for x in n.tolist()], dtype=np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Shard:
    """Both levels of the index for some documents, postings ordered by term."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, documents: int, total: int):
        order = np.argsort(terms, kind="stable")
        self.docs = len(n)
        self.doc = np.repeat(np.arange(len(n)), sizes)[order]
        self.tf, self.m = counts[order], length_factors(n, documents, total)
        self.bytes = (-(-impacts(self.tf, self.m[self.doc]) // STEP)).astype(np.uint8)
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(starts, len(terms))

    def best(self, wanted: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best k, or reach the score ``floor``, with their exact scores."""
        at = np.searchsorted(self.terms, wanted)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == wanted[here]
        at, weights = at[here], weights[here]
        if not len(at):
            return np.array([], np.int64), np.array([], np.int64)
        spans = list(zip(self.starts[at].tolist(), self.starts[at + 1].tolist(), strict=True))
        doc = np.concatenate([self.doc[a:b] for a, b in spans])
        steps = np.concatenate([self.bytes[a:b] for a, b in spans])
        per_step = np.repeat((weights * STEP).astype(np.float64), [b - a for a, b in spans])
        upper = np.bincount(doc, per_step * steps, self.docs)
        lower = upper - np.bincount(doc, per_step * (steps > 0), self.docs)
        bound = np.partition(lower, self.docs - k)[self.docs - k] if self.docs > k else 0
        may = (upper >= max(bound, floor)) & (upper > 0)
        hits = np.flatnonzero(may[doc])  # their postings, in the second level
        ends = np.cumsum([b - a for a, b in spans])
        term = np.searchsorted(ends, hits, side="right")
        posting = self.starts[at + 1][term] - (ends[term] - hits)
        exact = np.zeros(self.docs, np.int64)
        np.add.at(exact, doc[hits], weights[term] * impacts(self.tf[posting], self.m[doc[hits]]))
        found = np.flatnonzero(exact > 0)
        return found, exact[found]


def shards(batches: Iterable[pa.RecordBatch], documents: int, total: int) -> Iterator[tuple[pa.Array, Shard]]:
    """The rows of a task as shards, each with its documents' ids."""

    def shard(held: list[pa.RecordBatch]) -> tuple[pa.Array, Shard]:
        table = pa.Table.from_batches(held).combine_chunks()
        terms, counts = table["terms"].combine_chunks(), table["counts"].combine_chunks()
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
        columns = table["n"].to_numpy(), sizes, terms.flatten().to_numpy(), counts.flatten().to_numpy()
        return table["doc_id"].combine_chunks(), Shard(*columns, documents, total)

    held: list[pa.RecordBatch] = []
    docs = postings = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        docs, postings = docs + batch.num_rows, postings + len(batch.column("terms").flatten())
        if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
            yield shard(held)
            held, docs, postings = [], 0, 0
    if held:
        yield shard(held)


def best_documents(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int = K) -> DataFrame:
    """query (its number), doc_id, score, rank: the k best of each query.

    A task goes through its shards and keeps each query's best so far, which raise the bound for the shards after it;
    it returns k rows a query at most, and a window with a limit of its own takes the best of all tasks.
    """
    sent = index.sparkSession.sparkContext.broadcast((queries, weights))
    schema = T.StructType([T.StructField("query", T.IntegerType()), index.schema["doc_id"], T.StructField("score", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = sent.value
        best: list[list[tuple]] = [[] for _ in wanted]
        kind = pa.null()
        for ids, shard in shards(batches, documents, total):
            kind = ids.type
            ids = ids.to_pylist()
            for q, terms in enumerate(wanted):
                floor = -best[q][-1][0] if len(best[q]) == k else 1
                at, scores = shard.best(terms, weight[terms], k, floor)
                if len(at):
                    new = [(-s, ids[d] is None, ids[d]) for d, s in zip(at.tolist(), scores.tolist(), strict=True)]
                    best[q] = heapq.nsmallest(k, best[q] + new, key=lambda x: x[:2] if x[1] else x)
        rows = [(q, x[2], -x[0]) for q, kept in enumerate(best) for x in kept]
        if rows:
            numbers, ids, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(ids, kind), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    found = index.filter("size(terms) > 0").select("doc_id", "n", "terms", "counts").mapInArrow(search, schema)
    ranking = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.select("*", F.row_number().over(ranking).alias("rank")).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, texts: list[tuple[str, bytes]], k: int = K, **columns: str) -> DataFrame:
    """key, doc_id, score, rank for each of the query ``texts`` (key, text), which one pass searches for."""
    spark, table = docs.sparkSession, terms_table()
    asked = [list(dict.fromkeys(terms_of(text, table))) for _, text in texts]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for terms in asked for t in terms))}
    seen, path = Observation(), shared_path(spark, "postings")
    sums = [F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")]
    posted(docs, vocabulary, **columns).observe(seen, *sums).write.parquet(path)
    index, (n, total) = spark.read.parquet(path), (seen.get["documents"], seen.get["terms"])
    held = np.zeros(len(vocabulary), dtype=np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        held[row["term"]] = row["count"]
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * held + 1))).astype(np.int64)
    found = best_documents(index, [np.array([vocabulary[t] for t in terms], dtype=np.int64) for terms in asked], weights, n, max(total, 1), k)
    keys = spark.createDataFrame(list(enumerate(key for key, _ in texts)), "query int, key string")
    return found.join(F.broadcast(keys), "query").select("key", "doc_id", "score", "rank")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, item_id: str = "item_id", item_text: str = "text", **columns: str) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item, scores above 0.

    Every row of ``items`` is an item, every row of ``docs`` a document; null texts have no terms, and an item without
    terms, or an empty table, gives no rows. Of equal scores the smaller doc_id comes first, a null one last. Long texts
    are taken whole. Equal item texts are searched for once. The distinct ones go to the tasks in blocks of about ``block_bytes``,
    which are counted; each block is a pass over the documents.
    """
    asked = items.select(F.col(item_id).alias("item_id"), whole(item_text).alias("text")).select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text")
    distinct = asked.select("key", "text").dropDuplicates(["key"])
    blocks = max(1, -(-(distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    part = F.pmod(F.xxhash64("key"), F.lit(blocks))
    out = None
    for block in range(blocks):
        texts = [(r["key"], r["text"].encode()) for r in distinct.filter(part == block).collect()]
        found = ranked(docs, texts, k, **columns)
        out = found if out is None else out.union(found)
    return asked.select("item_id", "key").join(out, "key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13(docs: DataFrame, items: DataFrame) -> DataFrame:
    return ranked_search(docs, items)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = f"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '{TERM}') AS terms FROM documents
), totals AS (
  SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM words
), postings AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM words) GROUP BY r, term
), weighted AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term
), asked AS (
  SELECT item, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '{TERM}'))) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
), lengths AS (
  SELECT r, doc_id, 100 - 50 + (50 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM words, totals WHERE n_terms > 0
), scored AS (
  SELECT item, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weighted USING (term) JOIN postings USING (term) JOIN lengths USING (r) GROUP BY item, item_id, r, doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= {K}
"""
