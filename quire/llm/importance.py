"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A text becomes a bag of hashed features: words, punctuation runs, and pairs of
neighbours; a word that repeats its neighbour is one feature of its own, whatever the
word. The raw model counts the features of all documents, the target model those of the
labelled good ones. Per bucket the target is smoothed towards the raw model, and a
document's log-weight is its mean log(target/raw), as if every text had ``LENGTH``
features, since otherwise the length would decide.

Sampling keeps the k documents with the largest log-weight plus Gumbel noise, a draw
without replacement in proportion to the weights. As a classifier, k is the number of
documents whose weight exceeds the cut that best parts good from bad among labelled
documents that the target model has not seen; the noise blurs that cut.

At most ``MAX_LABELS`` labelled documents are used (those of least hash), half for the
model and half for the cut; that bounds what is broadcast. The raw model, the weights and
the draw cover all documents. Counts are vectors of fixed length per task, summed bucket
by bucket; histograms of weights have a bounded number of bins, so nothing that reaches
the driver grows with the corpus.

Rows: one result per document. Null and empty texts have no features and weight 0; whole
texts are read; equal keys go by id, and repeated rows that tie with the last one drawn
are kept together; rows without an id share one noise and come last of equals. An empty
table gives an empty result; where the labels show no good or no bad document everything
is kept. Labels may repeat (the worst counts) or be null (not used).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.batches import add_columns, prepared
from quire.session import stage_table

BUCKETS = 1 << 16
#: Smoothing: so many features are added to a bucket's target count and to its expected count.
PRIOR = 20.0
#: The number of features that every text counts for.
LENGTH = 200.0
#: At most so many labelled documents are used.
MAX_LABELS = 20_000
SEED = 11

PIECE = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]+")
MAX_CACHED = 200_000
_REPEAT = np.uint32(0x5BD1E995)


class _Hashes(dict):
    def __missing__(self, piece: bytes) -> int:
        if len(self) > MAX_CACHED:
            self.clear()
        h = self[piece] = xxhash.xxh32_intdigest(piece, SEED)
        return h


def make_features() -> Callable[[str | None], np.ndarray]:
    """A function from a text to the buckets of its features, repeats included."""
    hashes = _Hashes()

    def features(text: str | None) -> np.ndarray:
        pieces = PIECE.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
        n = len(pieces)
        h = np.fromiter(map(hashes.__getitem__, pieces), np.uint32, n)
        pair = (h[:-1] * np.uint32(0x9E3779B1) ^ h[1:]) * np.uint32(0x85EBCA6B)
        pair = np.where(h[:-1] == h[1:], _REPEAT, pair ^ (pair >> np.uint32(15)))
        return np.concatenate([h, pair]) & np.uint32(BUCKETS - 1)

    return features


def feature_counts(docs: DataFrame, target: Column, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all rows and over the rows where ``target`` holds; two vectors of fixed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = make_features()
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t, g in zip(b.column(0), b.column(1), strict=True):
                f = np.bincount(features(t.as_py()), minlength=BUCKETS)
                raw += f
                if g.as_py():
                    good += f
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    rows = docs.select(text, F.coalesce(target, F.lit(False))).mapInArrow(run, "bucket int, raw long, good long")
    table = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    out = np.zeros((2, BUCKETS))
    out[0, table["bucket"]] = table["raw"]
    out[1, table["bucket"]] = table["good"]
    return out[0], out[1]


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log(target / raw) per bucket; the target model is smoothed towards the raw one."""
    if not good.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    return np.log((good + PRIOR) / (raw * (good.sum() / raw.sum()) + PRIOR))


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``n_features`` and ``log_weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))  # one number per bucket

    def make():
        features, values = make_features(), shared.value

        def row(t):
            f = features(t)
            return len(f), LENGTH * float(values[f].mean(dtype=np.float64)) if len(f) else 0.0

        return row

    return add_columns(docs, [text], [T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType())], make)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on ``key`` alone."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def best_cut(bins: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the largest balanced accuracy, in the middle of the gap where it is one.

    ``bins`` are ascending weights, ``good`` and ``bad`` the documents that have them.
    """
    if not good.sum() or not bad.sum():
        return -np.inf
    gain = np.concatenate([[0.0], np.cumsum(bad) / bad.sum() - np.cumsum(good) / good.sum()])
    i = int(np.argmax(gain))
    if i == 0:
        return -np.inf
    return float(bins[-1] + 1 if i == len(bins) else (bins[i - 1] + bins[i]) / 2)


def labelled(labels: DataFrame, limit: int = MAX_LABELS) -> DataFrame:
    """``(doc_id, good, fold)`` of at most ``limit`` labelled documents, those of least hash."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    h = F.xxhash64("doc_id", F.lit(SEED))
    return known.orderBy(h, "doc_id").limit(limit).select("doc_id", "good", F.pmod(h, F.lit(2)).alias("fold"))


def _kth_largest(keyed: DataFrame, k: int) -> tuple[float, int]:
    """``(key, id rank)`` of the k-th row by key, then id, both descending; found through two histograms."""
    low, width, rest = None, 1.0 / 16, k
    rows = keyed
    for _ in range(2):
        slot = F.floor((F.col("key") - (0.0 if low is None else low)) / width)
        counts = rows.groupBy(slot.alias("slot")).count().orderBy(F.desc("slot")).collect()  # weights are bounded, so are the slots
        for r in counts:
            if rest <= r["count"]:
                break
            rest -= r["count"]
        rows = rows.where(slot == r["slot"])
        low, width = (0.0 if low is None else low) + r["slot"] * width, width / (1 << 16)
    last = rows.orderBy(F.desc("key"), F.desc("tie")).limit(rest).orderBy("key", "tie").first()
    return last["key"], last["tie"]


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = MAX_LABELS) -> DataFrame:
    """``docs`` with ``n_features``, ``log_weight``, ``key`` (the weight with noise) and ``kept``."""
    prepared(docs.sparkSession)
    known = F.broadcast(stage_table(labelled(labels, limit), "labels"))  # at most ``limit`` rows
    tagged = docs.select("doc_id", text).join(known, "doc_id", "left")
    ratio = log_ratio(*feature_counts(tagged, F.col("good") & (F.col("fold") == 0), text))

    tie = F.coalesce(-F.col("doc_id"), F.lit(-(1 << 62)))
    noisy = F.col("log_weight") + gumbel(F.col("doc_id"))
    weights = weigh(tagged, ratio, text).select("log_weight", "good", "fold", noisy.alias("key"), tie.alias("tie"))
    weights = stage_table(weights, "weights")
    bins = weights.where("fold = 1").groupBy(F.round("log_weight", 1).alias("bin")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    ).orderBy("bin").toPandas()
    cut = best_cut(bins["bin"].to_numpy(float), bins["good"].to_numpy(float), bins["bad"].to_numpy(float))
    k = weights.where(F.col("log_weight") > cut).count() if cut > -np.inf else None
    weighed = weigh(docs, ratio, text).withColumn("key", noisy)
    if k is None:
        kept = F.lit(True)
    elif k == 0:
        kept = F.lit(False)
    else:
        key, last = _kth_largest(weights, k)
        kept = (F.col("key") > key) | ((F.col("key") == key) & (tie >= last))
    return weighed.withColumn("kept", kept)


def keep_drawn(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, with the columns of ``docs`` alone, whatever their names."""
    names = docs.columns
    inner = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)]
    drawn = resample(docs.toDF(*inner), labels, **options).where("kept")
    return drawn.select(*[F.col(i).alias(c) for i, c in zip(inner, names, strict=True)])
