"""Best-fit packing with large-item matching: documents' tokens into sequences of a fixed capacity."""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import cut, texts_for_python, whole

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are ranked together, about.
RANK_ROWS = 1 << 16


def vocabulary_paths() -> tuple[str, str]:
    """Files of the byte-level vocabulary: for tokenizers, and the same vocabulary as ranks, for tiktoken."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


#: What only tokenizers encodes: texts with a character beyond ASCII, Latin letters and common quotes and dashes, with
#: a special token's string, or with a long run of white space.
NOT_PLAIN = re.compile(r"[^\x00-\x7F\u00A1\u00AB\u00BB\u00BF-\u017F\u2013\u2014\u2018-\u201E\u2026\u20AC]|<\|endoftext\|>|\s{100}")

#: The same for texts within Latin-1, whose bytes are looked at as a whole.
PLAIN_BYTES = bytes(b for b in range(256) if not NOT_PLAIN.search(chr(b)))
AS_BLANK = bytes(32 if chr(b).isspace() else b for b in range(256))


def plain(text: str) -> bool:
    """Whether NOT_PLAIN finds nothing in the text."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return not NOT_PLAIN.search(text)
    return not raw.translate(None, PLAIN_BYTES) and b"<|endoftext|>" not in raw and b" " * 100 not in raw.translate(AS_BLANK)


_encoders: dict[tuple[str, str], Callable[[str], np.ndarray]] = {}


def encoder(paths: tuple[str, str]) -> Callable[[str], np.ndarray]:
    """text -> ids as tokenizers gives them for the first file, made once a worker.

    Plain texts are encoded by tiktoken, which takes less than half the time: the files hold one vocabulary, and the
    tests compare both on every plain character in all its surroundings. All other texts go to tokenizers itself.
    """
    if paths not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        whole_file = Tokenizer.from_file(paths[0])
        with open(paths[1], "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if not plain(text):
                return np.array(whole_file.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            return fast.encode_to_numpy(text)

        _encoders[paths] = encode
    return _encoders[paths]


def cuts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``n`` ids: only what is longer than the capacity is cut, the first piece may be shorter."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and ``end_id``; a null or empty text is one piece of one id. The string of a special
    token in a text is that token.
    """
    paths = paths or vocabulary_paths()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(paths)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text), end_id).astype("<u4")
                for k, at in enumerate(cuts(len(ids), capacity)):
                    part = ids[at : (at + capacity if k or len(ids) % capacity == 0 else at + len(ids) % capacity)]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())) + ((part.tolist(),) if with_ids else ()))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"doc_id": batch["doc_id"].dtype}) if len(out) else out.reindex(columns=columns)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    # ids travel as they came, null too: as a string they keep null and value apart for every type
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), whole(text_col).alias("text"))
    return texts_for_python(rows).mapInPandas(pieces, schema.replace(f"doc_id {kind}", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast(kind))


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Runs of pieces that go to runs of sequences: length, first (rank among pieces of the length), n, sequence, offset.

    Only the histogram of lengths is needed, at most ``capacity`` numbers, so the plan is the same work for any
    number of documents: equal lengths move in runs, as one. Large pieces, above a third of the capacity, meet
    at most in twos: the longest is matched with the longest other that fits beside it. Smaller ones follow
    from long to short, each to the fullest sequence that has room. Sequences are numbered by runs.
    """
    left = {n: c for n, c in counts.items() if c}
    rank: dict[int, int] = defaultdict(int)
    rooms: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # room -> runs of sequences (first, n)
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        plan.append((length, rank[length], n, sequence, offset))
        rank[length] += n
        left[length] -= n

    third = capacity // 3
    large = sorted((x for x in left if x > third), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and left[x] > (x == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, opened, 0)
            if b is not None:
                put(b, n, opened, a)
            if room := capacity - a - (b or 0):
                rooms[room].append((opened, n))
            opened += n
    for a in sorted((x for x in left if x <= third), reverse=True):
        room = a
        while left[a]:
            while room < capacity and not rooms[room]:
                room += 1
            if room >= capacity:  # no gap: open sequences for the rest, as many pieces in each as fit
                per = capacity // a
                n = max(1, left[a] // per) if left[a] >= per else 1
                here = min(per, left[a])
                for k in range(here):
                    put(a, n, opened, k * a)
                if capacity - here * a:
                    rooms[capacity - here * a].append((opened, n))
                opened += n
                room = a
                continue
            first, n = rooms[room].popleft()
            if (take := min(n, left[a])) < n:
                rooms[room].appendleft((first + take, n - take))
            put(a, take, first, capacity - room)
            if room - a:
                rooms[room - a].append((first, take))
                room = room - a if room - a >= a else room
    return pd.DataFrame(plan, columns=["length", "first", "n", "sequence", "offset"]).astype("int64")


def ranked_by_length(pieces: DataFrame) -> DataFrame:
    """``pieces`` with rank, gapless from 0 among the pieces of one length.

    A length may hold a third of all pieces, so it is dealt over salts, by a hash of id and piece: ranks are
    counted within a salt and start where the salts before end. The number of salts follows the input.
    """
    salts = max(1, pieces.count() // RANK_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "salt"]).withColumn("rank", F.col("from") + F.col("at")).drop("salt", "at", "from")


def assign(ranked: DataFrame, plan: pd.DataFrame) -> DataFrame:
    """``ranked`` with sequence_id and offset. The plan's size is bounded by the capacity, so it is sent to all tasks."""
    by = plan.sort_values(["length", "first"])
    table = {c: by[c].to_numpy() for c in by.columns}
    starts = table["length"] * (1 << 44) + table["first"]
    sent = ranked.sparkSession.sparkContext.broadcast((starts, table["first"], table["sequence"], table["offset"]))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, first, sequence, offset = sent.value
        i = np.searchsorted(starts, length.to_numpy() * (1 << 44) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[i] + rank.to_numpy() - first[i], "offset": offset[i]})

    return ranked.withColumn("_place", place("length", "rank")).select("*", "_place.sequence_id", "_place.offset").drop("_place", "rank")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces(doc_id, piece, length, ids_crc32, ...)`` with sequence_id and offset; no sequence exceeds the capacity."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    return assign(ranked_by_length(pieces), packing_plan(counts, capacity))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end id; ids may be null or repeat, and repeated rows are packed as often as they
    occur; an empty table gives no rows. Tokens are counted once and not shuffled; pieces travel as six numbers.
    """
    return pack_pieces(cut(token_pieces(docs, id_col, text_col, capacity, end_id)), capacity)


def op2(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
