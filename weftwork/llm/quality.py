"""Quality rules: base counts, and divergence from language references with length guards."""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import counted_cut, cut, if_small, located, texts_for_python, whole

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A text's histograms are compared from these lengths on; shorter ones say too little.
GUARD_CHARS = 200
GUARD_WORDS = 50
#: A document's share in a bin of its language's reference counts in these parts of one, so that sums are whole.
SHARE_UNITS = 1_000_000
#: Jensen-Shannon distances (square root of the divergence, base 2) above which a text is rejected, for each language
#: from the texts that its reference is made of. Characters: their median and so much more. Common words: a histogram
#: of n words is off by chance in proportion to 1 / sqrt(n), so distances times sqrt(n) are compared: their median and
#: so many times the distance of their quartiles; but never below the floor, however long a text is.
CHAR_MARGIN = 0.20
WORD_SPREADS = 3.0
WORD_FLOOR = 0.15

#: Unicode's categories, by class; ASCII white space is space.
CLASSES = {"lower": "Ll", "upper": "Lu Lt", "letter": "Lo Lm Mn Mc Me", "digit": "Nd Nl No", "space": "Zs Zl Zp", "punctuation": "Pc Pd Ps Pe Pi Pf Po", "symbol": "Sm Sc Sk So", "control": "Cc Cf Cs Co Cn"}
#: Marks that part from a word before it is looked up.
MARKS = ".,;:!?'\"()"
#: Frequent function words of the languages, most frequent first.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not this are from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un une du que est dans qui par pour au sur pas avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es".split(),
}
N_COMMON = 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CHAR_BINS = [f"c_{c}" for c in CLASSES]
WORD_BINS = [f"w_{i}" for i in range(N_COMMON + 1)]


def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """Classes of all code points in order, as runs of one class and their lengths.

    Made on the driver and sent along with what uses it: a worker needs no module of this package for it.
    """
    of = {category: k for k, name in enumerate(CLASSES) for category in CLASSES[name].split()}
    table = np.fromiter((of[unicodedata.category(chr(c))] for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[[9, 10, 11, 12, 13, 32]] = list(CLASSES).index("space")
    starts = np.flatnonzero(np.diff(table, prepend=255))
    return table[starts], np.diff(starts, append=len(table))


def class_table(runs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Class of each code point."""
    return np.repeat(*(runs or class_runs()))


def class_counts(text: str, bins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Characters of a text by class; ``bins`` are the counts of its bytes."""
    if text.isascii():
        return np.bincount(classes[:128], weights=bins[:128], minlength=len(CLASSES)).astype(np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.bincount(classes[codes], minlength=len(CLASSES))


def lookup_table() -> bytes:
    """Bytes as words are looked up: A-Z lowered, marks as spaces."""
    return bytes(32 if chr(b) in MARKS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first time included.

    Words get numbers, and pairs of numbers get numbers again: three rounds number the windows of eight words
    exactly. A round without repeats ends it.
    """
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    size = 1
    while size < window:
        if len(ids) <= size:
            return 0
        pairs, ids, counts = np.unique(ids[:-size] * (int(ids.max()) + 1) + ids[size:], return_inverse=True, return_counts=True)
        if len(pairs) == len(ids):
            return 0
        size *= 2
    at = np.flatnonzero(counts[ids] > 1)
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return int((np.cumsum(steps) > 0).sum())


def text_counts(text: str, lang: str | None, classes: np.ndarray, lookup: bytes, common: dict[str, list[bytes]]) -> list[int]:
    """Base counts, characters by class, common words by rank and all other words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    bins = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = class_counts(text, bins, classes).tolist()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    found = Counter(raw.translate(lookup).split())
    ranked = [found[w] for w in common.get(lang, ())]
    ranked += [0] * (N_COMMON - len(ranked))
    symbols, blanks = int(sum(bins[ord(c)] for c in SYMBOLS)), int(bins[32] + bins[9:14].sum())
    return [len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words), *chars, *ranked, found.total() - sum(ranked)]


def counted(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", name: str = "counts") -> DataFrame:
    """``rows`` with a struct of the counts of each whole text; null counts as empty."""
    columns, runs = [*BASE, *CHAR_BINS, *WORD_BINS], class_runs()

    @F.pandas_udf(", ".join(f"{c} long" for c in columns))
    def count(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        tables = class_table(runs), lookup_table(), {k: [w.encode() for w in v] for k, v in COMMON_WORDS.items()}
        return pd.DataFrame([text_counts(t, g, *tables) for t, g in zip(texts, langs, strict=True)], columns=columns)

    once = count.asNondeterministic()  # else filters and joins above would each count the text anew
    return texts_for_python(rows).withColumn(name, once(whole(text_col), F.col(lang_col)))


def base_failed(counts: str = "counts") -> Column:
    n, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < MIN_WORDS) | (repeated * 100 > n * REPEAT_PERCENT)


def long_enough(counts: str = "counts") -> Column:
    chars = reduce(lambda a, b: a + b, [F.col(f"{counts}.{c}") for c in CHAR_BINS])
    return (chars >= GUARD_CHARS) & (F.col(f"{counts}.n_words") >= GUARD_WORDS)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, arrays of one length, in [0, 1]; null where one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    share = lambda a: F.get(F.transform(F.array(total(a)), lambda t: F.when(t > 0, F.transform(a, lambda v: v / t))), F.lit(0))
    part = lambda a, b: F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(F.lit(0.0))
    divergence = F.aggregate(F.zip_with(share(p), share(q), lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x) / 2
    return F.sqrt(F.when(divergence > 0, divergence).when(divergence.isNotNull(), 0.0))


def distances(rows: DataFrame, references: DataFrame, lang_col: str) -> DataFrame:
    """``rows`` and the reference of their language, with char_distance and word_distance, and the latter times sqrt(words).

    References have a row per language; they are counted and broadcast if they are few.
    """
    joined = rows.join(if_small(references), F.col(lang_col).cast("string").eqNullSafe(F.col("ref_lang")), "left")
    both = lambda bins: F.round(js_distance(F.array(*[f"counts.{c}" for c in bins]), F.array(*[f"reference.{c}" for c in bins])), 6)
    measured = joined.withColumn("char_distance", both(CHAR_BINS)).withColumn("word_distance", both(WORD_BINS))
    return measured.withColumn("word_excess", F.round(F.col("word_distance") * F.sqrt(F.col("counts.n_words").cast("double")), 2))


def fit_references(rows: DataFrame, lang_col: str = "lang") -> DataFrame:
    """One row per language of ``rows``, with their counts: ref_lang, a struct of the documents' mean histograms, summed, and limits.

    All texts that pass the base rules and the guards count, each with its shares: a very long text weighs as
    much as any other. Sums of whole numbers, combined before the shuffle: the same for any order of the rows. The limits
    are quantiles of the same texts' distances, so that what is odd in a language moves them little.
    """
    good = rows.filter(~base_failed() & long_enough())
    total = {c: F.nullif(reduce(lambda a, b: a + b, [F.col(f"counts.{x}") for x in bins]), F.lit(0)) for bins in (CHAR_BINS, WORD_BINS) for c in bins}
    sums = [F.sum(F.floor(F.col(f"counts.{c}") * SHARE_UNITS / n)).alias(c) for c, n in total.items()]
    means = cut(good.groupBy(F.col(lang_col).cast("string").alias("ref_lang")).agg(*sums).select("ref_lang", F.struct(*CHAR_BINS, *WORD_BINS).alias("reference")))
    at = lambda p, c: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")
    measured = distances(good, means, lang_col).select("ref_lang", F.round("char_distance", 3).alias("c"), F.col("word_excess").alias("w"))
    limits = measured.groupBy("ref_lang").agg((at(0.5, "c") + CHAR_MARGIN).alias("char_limit"), (at(0.5, "w") + WORD_SPREADS * (at(0.75, "w") - at(0.25, "w"))).alias("word_limit"))
    return means.join(limits.withColumnRenamed("ref_lang", "_lang"), F.col("ref_lang").eqNullSafe(F.col("_lang"))).drop("_lang")


def judged(rows: DataFrame, references: DataFrame, lang_col: str = "lang") -> DataFrame:
    """``rows`` with counts, as ``counted`` gives them, and char_distance, word_distance, base_failed, kept.

    A text under the guards, or of a language without a reference, is judged by the base rules alone.
    """
    measured = distances(rows, references, lang_col)
    far = (F.col("char_distance") > F.col("char_limit")) | (F.col("word_distance") > F.greatest(F.lit(WORD_FLOOR), F.col("word_limit") / F.sqrt(F.col("counts.n_words").cast("double"))))
    told = measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(long_enough() & far, F.lit(False)))
    return told.drop("ref_lang", "reference", "char_limit", "word_limit", "word_excess")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", references: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, the counts, char_distance, word_distance, base_failed, kept.

    Null and empty texts have no words and fail; null languages are a language of their own, without common
    words; repeated rows are judged alike; an empty table gives no rows. Texts are read once.
    """
    rows = counted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))).drop("text")
    if references is None:
        rows = cut(rows)
        references = cut(fit_references(rows))
    return judged(rows, references).select("doc_id", *[f"counts.{c}" for c in BASE], "base_failed", "kept", "char_distance", "word_distance")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, same columns, which may have any names.

    Null and empty texts go; null languages are a language of their own; repeated rows stay or go together; of an
    empty table nothing stays. Texts are counted once; the counts are kept with their rows' locators, and the locators
    of what goes are joined away.
    """
    rows = located(docs)
    counts = cut(counted(rows.select("file", "row", F.col("record")[text_col].alias("text"), F.col("record")[lang_col].alias("lang"))).drop("text"))
    goes, n = counted_cut(judged(counts, cut(fit_references(counts))).filter("not kept").select("file", "row"))
    return rows.join(if_small(goes, rows=n), ["file", "row"], "left_anti").select("record.*")


def op1(docs: DataFrame) -> DataFrame:
    return quality_rules(docs)


def _sql() -> str:
    """The same in SQL: windows as joined slices, histograms as lists."""
    common = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items())
    keep = {
        "lower": r"\p{Ll}", "upper": r"[\p{Lu}\p{Lt}]", "letter": r"[\p{Lo}\p{Lm}\p{M}]", "digit": r"\p{N}", "space": r"[\x20\x09-\x0D\p{Z}]", "punctuation": r"\p{P}",
        "symbol": r"\p{S}", "control": r"[^\P{C}\x09-\x0D]",
    }
    only = lambda text, kind: f"length({text}) - length(regexp_replace({text}, '{kind}', '', 'g'))"
    chars = ", ".join(only("t", keep[c]) for c in CLASSES)
    distance = lambda p, q: (
        f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN round(sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: "
        f"(CASE WHEN {p}[i] > 0 THEN {p}[i] / list_sum({p}) * log2({p}[i] / list_sum({p}) * 2 / ({p}[i] / list_sum({p}) + {q}[i] / list_sum({q}))) ELSE 0 END)"
        f" + (CASE WHEN {q}[i] > 0 THEN {q}[i] / list_sum({q}) * log2({q}[i] / list_sum({q}) * 2 / ({q}[i] / list_sum({q}) + {p}[i] / list_sum({p}))) ELSE 0 END))) / 2, 0)), 6) END"
    )
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i + 1}] * {SHARE_UNITS} // list_sum({name}))::DOUBLE" for i in range(n)) + "]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
  regexp_extract_all(translate(regexp_replace(t, '[.,;:!?''"()]', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS found,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  coalesce(CASE lang {common} END, []) AS common FROM d),
windows AS (SELECT r, unnest(range(1, len(words) - {WINDOW} + 2)) AS i, words FROM w WHERE len(words) >= {WINDOW}),
keyed AS (SELECT r, i, array_to_string(words[i:i + {WINDOW} - 1], ' ') AS k FROM windows),
twice AS (SELECT r, i FROM keyed QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r),
c AS (SELECT w.r, doc_id, lang, len(words)::BIGINT AS n_words, list_sum(list_transform(words, lambda x: length(x)))::BIGINT AS wc,
  {only("t", "[#*$%&|<>]")} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
  [{chars}] AS ch, list_transform(range(1, {N_COMMON} + 1), lambda j: CASE WHEN j <= len(common) THEN len(list_filter(found, lambda x: x = common[j])) ELSE 0 END) AS ranked, len(found) AS n_found
  FROM w LEFT JOIN covered USING (r)),
h AS (SELECT *, list_append(ranked, n_found - list_sum(ranked)) AS wo, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  list_sum(ch) >= {GUARD_CHARS} AND n_words >= {GUARD_WORDS} AS enough FROM c),
ref AS (SELECT lang AS ref_lang, {sums("ch", len(CLASSES))} AS qc, {sums("wo", N_COMMON + 1)} AS qw FROM h WHERE NOT base_failed AND enough GROUP BY lang),
j AS (SELECT h.*, list_transform(ch, lambda x: x::DOUBLE) AS pc, list_transform(wo, lambda x: x::DOUBLE) AS pw, qc, qw FROM h LEFT JOIN ref ON h.lang IS NOT DISTINCT FROM ref_lang),
m AS (SELECT *, {distance("pc", "qc")} AS char_distance, {distance("pw", "qw")} AS word_distance FROM j),
lim AS (SELECT lang AS lim_lang, quantile_disc(round(char_distance, 3), 0.5) + {CHAR_MARGIN} AS char_limit,
  quantile_disc(w, 0.5) + {WORD_SPREADS} * (quantile_disc(w, 0.75) - quantile_disc(w, 0.25)) AS word_limit
  FROM (SELECT *, round(word_distance * sqrt(n_words), 2) AS w FROM m WHERE NOT base_failed AND enough) GROUP BY lang)
SELECT doc_id, n_words, coalesce(wc, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(enough AND (char_distance > char_limit OR word_distance > greatest({WORD_FLOOR}, word_limit / sqrt(n_words))), false) AS kept, char_distance, word_distance
FROM m LEFT JOIN lim ON m.lang IS NOT DISTINCT FROM lim_lang
"""


SQL = _sql()
