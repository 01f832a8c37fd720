"""Quality classifier by co-training: a text view and a metadata view teach each other, then score everything.

Both views' features of each document are made once and written; every round scores all of them. In a round a view
names, for each class, the documents of its most extreme scores, a fixed share of the corpus; a seeded sample
of these joins what the other view learns from and stays there. What a view has to say about its class weighs as much as
its calibrated score differs from what is known without it, so that a view that knows little moves little.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import cut, delete, shared_path, texts_for_python, whole
from weftwork.llm.quality import CLASSES, class_counts, class_runs, class_table, lookup_table

#: Labelled rows that the views are fitted on, at most; chosen by a hash of their ids.
MAX_LABELLED = 4000
#: Share of them that is held out to calibrate and combine the views.
HELD_OUT = 0.25
ROUNDS = 2
#: In a round each view names, for each class, this share of all documents: those of its most extreme scores.
NAMED = 0.05
#: Of these about so many are drawn by a hash of their texts, for each view, class and round, to fit the other view on.
EXCHANGED = 400
#: A drawn row weighs at most so much, a labelled one 1.
DRAWN_WEIGHT = 0.5
#: Scores are counted in bins of this width of the log-odds.
BIN = 1 / 64
KEEP_FROM = 0.5

WORD_DIM, EXTRA = 2048, len(CLASSES) + 3
SOURCE_DIM, LANG_DIM, LENGTH_DIM = 256, 32, 24
TEXT_DIM, META_DIM = WORD_DIM + EXTRA, SOURCE_DIM + LANG_DIM + LENGTH_DIM
FEATURES = "text_at array<int>, text_by array<float>, meta_at array<int>"
#: Kinds of rows that are exchanged: by which view, and as which class.
KINDS = (("text", 1), ("text", 0), ("meta", 1), ("meta", 0))


def text_features(text: str, classes: np.ndarray, lookup: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: hashed words at unit length, shares of character classes, word length, repetition."""
    raw = text.encode("utf-8", "surrogatepass")
    words = Counter(raw.translate(lookup).split())
    n = words.total()
    if not n:
        return np.array([], dtype=np.int32), np.array([], dtype=np.float32)
    at = np.fromiter((zlib.crc32(w) % WORD_DIM for w in words), dtype=np.int32, count=len(words))
    by = np.log1p(np.fromiter(words.values(), dtype=np.float32, count=len(words)))
    sums = np.bincount(at, weights=by, minlength=WORD_DIM)
    at = np.flatnonzero(sums)
    bins = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = class_counts(text, bins, classes).astype(np.float64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    extra = [*(chars / max(1.0, chars.sum())), min(1.0, chars.sum() / n / 20), len(words) / n, len(set(lines)) / max(1, len(lines))]
    return np.concatenate([at, WORD_DIM + np.arange(EXTRA)]).astype(np.int32), np.concatenate([sums[at] / np.linalg.norm(sums[at]), extra]).astype(np.float32)


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> list[int]:
    """Places of ones: hashed source, hashed language, length by powers of two; null is a value of its own."""
    code = lambda x, dim: 0 if x is None else 1 + zlib.crc32(str(x).encode("utf-8", "surrogatepass")) % (dim - 1)
    size = 0 if n_chars is None or not n_chars > 0 else min(LENGTH_DIM - 1, 1 + int(math.log2(n_chars)))
    return [code(source, SOURCE_DIM), SOURCE_DIM + code(lang, LANG_DIM), SOURCE_DIM + LANG_DIM + size]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights, the last one the bias, of a logistic regression with balanced classes, by accelerated descent."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    share = (weight * np.where(y > 0, 0.5 / (weight[y > 0].sum() or 1), 0.5 / (weight[y == 0].sum() or 1))).astype(x.dtype)
    v = np.ones(x.shape[1], dtype=x.dtype)
    for _ in range(8):
        v = x.T @ (share * (x @ v))
        v /= np.linalg.norm(v) or 1
    rate = 1 / (0.3 * float(v @ (x.T @ (share * (x @ v)))) + l2)
    w = np.zeros(x.shape[1], dtype=x.dtype)
    ahead = w
    for k in range(steps):
        new = ahead - rate * (x.T @ (share * (sigmoid(x @ ahead) - y).astype(x.dtype)) + l2 * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit_scale(columns: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Unbalanced logistic regression on a few columns by Newton steps: slopes and bias."""
    x = np.hstack([columns, np.ones((len(columns), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sums_of(at: pa.Array, weights: np.ndarray, by: pa.Array | None = None) -> np.ndarray:
    """For each list of places the sum of their weights, times the values ``by``; an empty list gives 0."""
    offsets = at.offsets.to_numpy()
    start, end = offsets[0], offsets[-1]
    each = weights[at.values.to_numpy(zero_copy_only=False)[start:end]].astype(np.float64)
    if by is not None:
        first = by.offsets.to_numpy()
        each *= by.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]]
    running = np.concatenate([[0.0], np.cumsum(each)])
    return running[offsets[1:] - start] - running[offsets[:-1] - start]


@dataclass
class Model:
    """Both views, their calibration and their combination; fixed in size."""

    text: np.ndarray = field(default_factory=lambda: np.zeros(TEXT_DIM + 1, np.float32))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(META_DIM + 1, np.float32))
    text_scale: tuple[float, float] = (1.0, 0.0)
    meta_scale: tuple[float, float] = (1.0, 0.0)
    combine: tuple[float, float, float] = (0.5, 0.5, 0.0)
    prior: float = 0.0  # log-odds of a held-out row, nothing else known

    def views(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of both views, of rows with features."""
        t = sums_of(batch.column("text_at"), self.text, batch.column("text_by")) + self.text[-1]
        m = sums_of(batch.column("meta_at"), self.meta) + self.meta[-1]
        return t * self.text_scale[0] + self.text_scale[1], m * self.meta_scale[0] + self.meta_scale[1]

    def both(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        return sigmoid(t * self.combine[0] + m * self.combine[1] + self.combine[2])


def dense(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x, z = np.zeros((len(rows), TEXT_DIM), np.float32), np.zeros((len(rows), META_DIM), np.float32)
    for i, (at, by, meta) in enumerate(zip(rows["text_at"], rows["text_by"], rows["meta_at"], strict=True)):
        x[i, list(at)] = list(by)
        z[i, list(meta)] = 1
    return x, z


def fit(labelled: pd.DataFrame, for_text: pd.DataFrame, for_meta: pd.DataFrame) -> Model:
    """``labelled`` rows with y and held, and the rows that each view got from the other, with y and weight."""
    model = Model()
    y = labelled["y"].to_numpy(np.float64)
    if not len(y):
        return model
    if y.min() == y.max():  # one class: its share is all there is to say
        log_odds = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        model.combine = (0.0, 0.0, log_odds)
        model.text_scale = model.meta_scale = (0.0, log_odds)
        return model
    x, z = dense(labelled)
    held = labelled["held"].to_numpy(bool)
    if min((held & (y > 0)).sum(), (held & (y == 0)).sum(), (~held & (y > 0)).sum(), (~held & (y == 0)).sum()) == 0:
        held, used = np.ones(len(y), bool), np.ones(len(y), bool)
    else:
        used = ~held
    more_x, more_z = dense(for_text)[0], dense(for_meta)[1]
    taught = lambda own, more, rows: fit_logistic(np.vstack([own[used], more]), np.concatenate([y[used], rows["y"].to_numpy(np.float64)]), np.concatenate([np.ones(used.sum()), rows["weight"].to_numpy(np.float64)]))
    model.text, model.meta = taught(x, more_x, for_text), taught(z, more_z, for_meta)
    t, m = x[held] @ model.text[:-1] + model.text[-1], z[held] @ model.meta[:-1] + model.meta[-1]
    model.text_scale, model.meta_scale = tuple(fit_scale(t[:, None], y[held])), tuple(fit_scale(m[:, None], y[held]))
    t, m = t * model.text_scale[0] + model.text_scale[1], m * model.meta_scale[0] + model.meta_scale[1]
    model.combine = tuple(fit_scale(np.stack([t, m], axis=1), y[held]))
    model.prior = math.log((y[held].sum() + 1) / ((1 - y[held]).sum() + 1))
    return model


def write_features(docs: DataFrame, path: str) -> DataFrame:
    """The features of both views of all rows, written to ``path`` and read from there.

    doc_id is a string, which keeps null and value apart for every type; content is a 64-bit hash of the text.
    """
    text, runs = whole("text"), class_runs()
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"),
    )

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = class_table(runs), lookup_table()
        for b in batches:
            texts = [text_features(t, *tables) for t in b["text"]]
            sizes = [None if pd.isna(x) else float(x) for x in b["n_chars"]]
            metas = [meta_features(s, g, n) for s, g, n in zip(b["source"], b["lang"], sizes, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": b["content"], "text_at": [x[0] for x in texts], "text_by": [x[1] for x in texts], "meta_at": metas})

    texts_for_python(rows).mapInPandas(features, f"doc_id string, content long, {FEATURES}").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def labelled_rows(features: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> pd.DataFrame:
    """Features and labels of the rows that the views are fitted on. At most ``max_labelled`` labels are broadcast."""
    agreed = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("y", "content", "text_at", "text_by", "meta_at"), F.struct("content", "meta_at")).alias("row"))
    found = rows.select("doc_id", "row.*").orderBy("doc_id").toPandas()
    found["held"] = [zlib.crc32(f"held:{i}".encode()) % 1000 < HELD_OUT * 1000 for i in found["doc_id"]]
    return found.astype({"held": bool})


def others_of(features: DataFrame, known: list[str]) -> DataFrame:
    """Rows of documents that have no label; the known ids are as many as labels are, and are broadcast."""
    ids = features.sparkSession.createDataFrame([(x,) for x in known], "doc_id string")
    return features.join(F.broadcast(ids), "doc_id", "left_anti")


def extreme_scores(others: DataFrame, model: Model, named: float = NAMED) -> list[tuple[int, int]]:
    """For each kind the bin of scores from which on, or up to which, a view names documents, and their number.

    All documents are scored and counted by bin; the counts alone reach the driver. A bin is named whole.
    """

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for view, z in zip(("text", "meta"), model.views(b), strict=True):
                bins, n = np.unique(np.floor(z / BIN).astype("int32"), return_counts=True)
                yield pa.RecordBatch.from_pydict({"view": [view] * len(bins), "bin": bins, "n": n.astype("int64")})

    counts = others.mapInArrow(binned, "view string, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for view, y in KINDS:
        own = counts[counts["view"] == view].sort_values("bin", ascending=not y)
        if not len(own):
            out.append((0, 0))
            continue
        upto = own["n"].cumsum()
        last = int(np.searchsorted(upto.to_numpy(), max(1, named * upto.iloc[-1])))
        out.append((int(own["bin"].iloc[last]), int(upto.iloc[last])))
    return out


def exchanged_rows(others: DataFrame, model: Model, extremes: list[tuple[int, int]], exchanged: int = EXCHANGED) -> pd.DataFrame:
    """Of the documents that each view names for each class a sample of about ``exchanged``, with features, y and weight.

    A text is drawn if a hash of it is low enough for the number of documents that are named, so no task has to
    keep a best list; rows with one text are drawn together and count once. The weight is how far the score, as odds, is
    from the prior.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            views = dict(zip(("text", "meta"), model.views(b), strict=True))
            draw = (b.column("content").to_numpy().view("uint64") * np.uint64(0x9E3779B97F4A7C15)).astype(np.float64) / 2.0**64
            for kind, ((view, y), (limit, n)) in enumerate(zip(KINDS, extremes, strict=True)):
                z = views[view]
                bins = np.floor(z / BIN)
                hit = np.flatnonzero(((bins >= limit) if y else (bins <= limit)) & (draw * n < exchanged))
                lift = np.maximum(0.0, (z[hit] - model.prior) * (1 if y else -1))
                part = b.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hit), kind, "int32")), pa.array(2 * sigmoid(lift) - 1), *[part.column(c) for c in ("content", "doc_id", "text_at", "text_by", "meta_at")]],
                    names=["kind", "weight", "content", "doc_id", "text_at", "text_by", "meta_at"],
                )

    found = others.mapInArrow(drawn, f"kind int, weight double, content long, doc_id string, {FEATURES}")
    once = found.groupBy("kind", "content").agg(F.min_by(F.struct("doc_id", "weight", "text_at", "text_by", "meta_at"), F.struct("doc_id", "meta_at")).alias("row"))
    rows = once.select("kind", "content", "row.*").orderBy("kind", "content").toPandas()
    rows["y"] = [KINDS[k][1] for k in rows["kind"]]
    rows["weight"] *= DRAWN_WEIGHT
    return rows


def co_train(features: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED, named: float = NAMED, exchanged: int = EXCHANGED) -> tuple[Model, list[pd.DataFrame]]:
    """Both views, fitted on the labelled rows and, round by round, on what the other has named; and the rounds' rows.

    What a view got in a round it keeps; a text that is named again counts as it was named last.
    """
    labelled = labelled_rows(features, labels, max_labelled)
    told: list[pd.DataFrame] = []
    none = labelled.iloc[:0].assign(weight=[], kind=[])
    model = fit(labelled, none, none)
    if not len(labelled) or labelled["y"].min() == labelled["y"].max():
        return model, told
    others = others_of(features, labelled["doc_id"].tolist())
    for _ in range(rounds):
        told.append(exchanged_rows(others, model, extreme_scores(others, model, named), exchanged))
        pool = pd.concat(told)
        by = lambda view: pool[[KINDS[k][0] == view for k in pool["kind"]]].drop_duplicates("content", keep="last")  # noqa: E731, B023
        model = fit(labelled, by("meta"), by("text"))
    return model, told


def score(features: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id (as string), text_score, meta_score, score, kept."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, m = model.views(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sigmoid(t)), pa.array(sigmoid(m)), pa.array(model.both(t, m))], names=["doc_id", "text_score", "meta_score", "score"])

    out = features.mapInArrow(scored, "doc_id string, text_score double, meta_score double, score double")
    return out.withColumn("kept", F.col("score") >= KEEP_FROM)


def classify_quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Scores of all documents by views that were co-trained on ``labels(doc_id, quality)``.

    Null and empty texts score by their bias and metadata; null metadata are values of their own; ids may be
    null or repeat, repeated rows score alike; texts of any length are one bag of 2048 hashed words. Labels without a
    document, null labels and null ids are left out; labels that disagree are averaged. Without labels all
    scores are 0.5; with labels of one class alone they are its smoothed share. An empty table gives no rows. The views
    are fitted on at most ``max_labelled`` labelled rows and about 4 * EXCHANGED rows a round that are drawn
    from all that the views name; scores and thresholds are over all documents.
    """
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "features")
    features = write_features(docs, path)
    model, _ = co_train(features, labels, rounds, max_labelled)
    out = cut(score(features, model))
    delete(spark, path)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify_quality(docs, labels)
