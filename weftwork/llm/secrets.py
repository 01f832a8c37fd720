"""Secret scans: fixed patterns, and sliding-window entropy per character class with an allow-list."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import SPANS, let, running_spans, whole

#: Kind, pattern and what a match must also be. A match that fails is dropped, not looked into.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # runs are whole, so these are the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGNED, MIN_ACCESS = 6, 20

#: Character classes: candidate strings (whole runs of the class), and the entropy in bits that a window must reach.
WINDOW = 20
CLASSES = (("hex", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}", 3.1), ("base64", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 3.85))
#: Allow-list: candidates that are a UUID; alphabets, counts and placeholders, at which a candidate is cut in pieces;
#: and high parts that are words and short numbers joined by signs.
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
PLACEHOLDER = r"(?i)abcdefghij|0123456789|1234567890|example|placeholder|x{6,}"
JOINTS, JOINED = r"[-_/+=]", r"^(?:[A-Za-z]*|[0-9]{1,8})$"

#: c log2 c in whole units, so that sums do not depend on the way they came about.
UNITS = 1 << 32
C_LOG_C = [round(c * math.log2(c) * UNITS) if c else 0 for c in range(WINDOW + 2)]
#: Windows that one pass looks at; a longer candidate is cut into chunks that overlap by a window less one.
CHUNK = 1024


def match_spans(text: Column, pattern: str) -> Column:
    """All matches of the pattern, leftmost and not overlapping, with code-point offsets (end exclusive).

    What stands between the matches comes from split(), the matches from regexp_extract_all(); offsets are
    running sums of their lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, gap: F.struct(F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("n"), m.alias("m")))
    return F.when(text.rlike(pattern), running_spans(parts)).otherwise(F.array().cast(SPANS))


def pieces(candidate: Column) -> Column:
    """What a candidate (start, end, text) has before, between and behind placeholders, as such structs."""
    text = candidate["text"]
    words = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    before = F.concat(F.array(F.lit("")), words)
    cut = F.zip_with(F.split(text, PLACEHOLDER, -1), before, lambda piece, word: F.struct(F.length(word).cast("long").alias("gap"), F.length(piece).cast("long").alias("n"), piece.alias("m")))
    moved = F.transform(running_spans(cut), lambda s: F.struct((s["start"] + candidate["start"]).alias("start"), (s["end"] + candidate["start"]).alias("end"), s["text"].alias("text")))
    return F.when(text.rlike(PLACEHOLDER), moved).otherwise(F.array(candidate))


RUNS = "array<struct<start:long,end:long>>"


def high_runs(chunk: Column, at: Column, threshold: float, window: int = WINDOW) -> Column:
    """Runs (start, end) of what a chunk's windows cover whose Shannon entropy reaches the threshold; the chunk is at ``at``.

    A window differs from the one before it by the character that enters and the one that leaves. How often these two
    occur in what both windows share says how much the sum of c log2 c grows and shrinks, and from that sum the entropy
    follows: one running sum over the chunk. High windows that overlap or touch are one run.
    """
    most = math.floor((math.log2(window) - threshold) * window * UNITS + 1)
    grows = F.array(*[F.lit(b - a).cast("long") for a, b in zip(C_LOG_C, C_LOG_C[1:], strict=False)])
    long = lambda n: F.lit(n).cast("long")
    times = lambda x, shared: F.octet_length(shared) - F.octet_length(F.replace(shared, x, F.lit("")))  # noqa: E731  candidates are ASCII

    def changes(chars: Column) -> Column:
        def change(x: Column, i: Column) -> Column:
            shared = F.substring(chunk, F.greatest(i - (window - 2), F.lit(1)), F.least(i, F.lit(window - 1)))
            left = F.get(chars, i - window)
            return let(shared, lambda m: F.get(grows, times(x, m)) - F.when(i >= window, F.get(grows, times(left, m))).otherwise(long(0)))

        return F.transform(chars, change)

    zero = F.struct(long(0).alias("sum"), long(0).alias("n"), long(-1).alias("start"), long(-1).alias("end"), F.array().cast(RUNS).alias("runs"))
    run = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))

    def step(s: Column, grown: Column) -> Column:
        n, total = s["n"] + 1, s["sum"] + grown
        high = (n >= window) & (total <= most)
        fresh = high & (n - window > s["end"])
        return F.struct(
            total.alias("sum"), n.alias("n"), F.when(fresh, n - window).otherwise(s["start"]).alias("start"), F.when(high, n).otherwise(s["end"]).alias("end"),
            F.when(fresh & (s["end"] >= 0), F.array_append(s["runs"], run(s))).otherwise(s["runs"]).alias("runs"),
        )

    found = F.aggregate(let(F.split(chunk, ""), changes), zero, step, lambda s: F.when(s["end"] >= 0, F.array_append(s["runs"], run(s))).otherwise(s["runs"]))
    return F.transform(found, lambda r: F.struct((r["start"] + at).alias("start"), (r["end"] + at).alias("end")))


def merged(runs: Column) -> Column:
    """Runs in order, those that overlap or touch as one."""
    starts = F.filter(runs, lambda r, i: F.coalesce(r["start"] > F.get(runs, i - 1)["end"], F.lit(True)))
    ends = F.filter(runs, lambda r, i: F.coalesce(F.get(runs, i + 1)["start"] > r["end"], F.lit(True)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def kinded(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def entropy_spans(text: Column) -> Column:
    """Spans of kind entropy: of each class's candidates, what high windows cover, unless it is allowed.

    A piece of a candidate is looked at from a window's length on, if it mixes letters and digits. Both classes may give
    the same span.
    """

    def of_class(pattern: str, threshold: float) -> Column:
        tried = F.filter(match_spans(text, pattern), lambda s: ~s["text"].rlike(UUID))
        cut = F.flatten(F.transform(tried, pieces))
        worded = lambda s: F.forall(F.split(s["text"], JOINTS), lambda part: part.rlike(JOINED))
        mixed = F.filter(cut, lambda s: (F.length(s["text"]) >= WINDOW) & s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]") & ~worded(s))
        chunks = lambda s: F.regexp_extract_all(s["text"], F.lit(rf"(?s)(?=(.{{1,{CHUNK + WINDOW - 1}}})).{{1,{CHUNK}}}"), F.lit(1))
        runs = lambda s: F.flatten(F.transform(chunks(s), lambda c, i: high_runs(c, s["start"] + i * CHUNK, threshold)))
        return F.flatten(F.transform(mixed, lambda s: let(runs(s), merged)))

    return F.concat(*[of_class(pattern, threshold) for _, pattern, threshold in CLASSES])


def secret_spans(text: Column) -> Column:
    """All spans of a text as (start, order, end, kind), by start and then by kind as listed in ``KINDS``."""
    assign = F.filter(match_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= MIN_ASSIGNED)
    access = F.filter(match_spans(text, ACCESS), lambda s: F.length(s["text"]) >= MIN_ACCESS)
    every = F.array_sort(F.concat(kinded(assign, "assign"), kinded(access, "access"), kinded(match_spans(text, HEX), "hex"), kinded(entropy_spans(text), "entropy")))
    return let(every, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1))))  # equal ones are next to each other


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and secrets, an array of (start, order, end, kind).

    Offsets are code points of the whole text, ends exclusive. Null and empty texts have none; ids may be null or
    repeat, and each row is scanned by itself; an empty table gives no rows. Work and memory grow in proportion
    to a text's length, however long one candidate is; rows are never shuffled.
    """
    return docs.select(F.col(id_col).alias("doc_id"), secret_spans(whole(text_col)).alias("secrets"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs)
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
