"""Quality classifier by importance resampling over hashed n-grams.

Two bag-of-n-grams models share one hash space: the target model counts the n-grams of labelled good documents,
the raw model those of all documents.  A document's log weight is the sum over its n-grams of
log(target probability / raw probability).  Sampling without replacement in proportion to powers of the weights is a
Gumbel top-k: each document's key is its log weight plus Gumbel noise from a hash of its id and text, and the k
largest keys are taken.  k is the number of documents whose weight reaches ``cut``, a threshold set on labelled
documents that trained neither model, so good documents are sampled and the rest is rejected.

The filter needs a cut that hardly varies: the noise is scaled by TEMPERATURE = 0.05, so the draw is in proportion to
the 20th power of the weights, near-deterministic, and differs from the hard cut only for log weights close to it.

n-grams are words, punctuation runs and pairs of neighbours, lower-cased; a pair of equal neighbours is one
feature whatever the word.  Labelled rows: at most ``per_class`` of each class, those with the smallest hash of
their id (a documented bound), half to fit and half to set the cut.  The raw model reads every document.

Defined results: a null or empty text has no n-grams and the log weight 0, which the cut never rejects.  Rows
with equal keys (repeated rows) are taken or left together, so ties may lift the sample above k.  A null doc_id
has a key from its text.  Without labels of both classes nothing is rejected.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table
from .words import WORD_PUNCT, mix, word_hashes

PER_CLASS, BUCKETS = 4000, 1 << 15
TEMPERATURE = 0.05
SMOOTHING = 0.5
BINS = 2000
_U = np.uint64


def ngrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the text that each belongs to."""
    words, counts = word_hashes(texts, WORD_PUNCT)
    owner = np.repeat(np.arange(len(counts)), counts)
    pair = mix(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:])
    pair[words[:-1] == words[1:]] = _U(1)
    inside = owner[:-1] == owner[1:]
    bucket = np.concatenate([words, pair[inside]]) % _U(BUCKETS // 2)
    bucket[len(words):] += _U(BUCKETS // 2)
    return bucket.astype(np.int64), np.concatenate([owner, owner[:-1][inside]])


def _blobs(texts: pa.Array, step: int = 512) -> Iterator[list[bytes | None]]:
    texts = texts.cast(pa.large_binary())
    for at in range(0, len(texts), step):
        yield texts.slice(at, step).to_pylist()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (part, text) to (part, bucket, n), summed over the task's rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        parts = batch.column(0).to_numpy(zero_copy_only=False)
        for part in np.unique(parts):
            texts = batch.column(1).filter(pa.array(parts == part))
            total = sums.setdefault(int(part), np.zeros(BUCKETS, np.int64))
            for blobs in _blobs(texts):
                total += np.bincount(ngrams(blobs)[0], minlength=BUCKETS)
    for part, total in sums.items():
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), part), pa.int32()), pa.array(bucket), pa.array(total[bucket])],
                                         names=["part", "bucket", "n"])


def _model(rows: DataFrame) -> np.ndarray:
    """Counts per bucket over all rows (part, text): BUCKETS numbers at most for each part reach the driver."""
    found = rows.mapInArrow(counted, "part int, bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


class Weights:
    """log(target / raw) of each bucket, and the cut."""

    def __init__(self, ratio: np.ndarray, cut: float = -math.inf) -> None:
        self.ratio, self.cut = ratio, cut

    def of(self, texts: pa.Array) -> np.ndarray:
        out = [np.empty(0)]
        for blobs in _blobs(texts):
            bucket, owner = ngrams(blobs)
            out.append(np.bincount(owner, weights=self.ratio[bucket], minlength=len(blobs)))
        return np.concatenate(out)

    def column(self, text: Column) -> Column:
        weights = self

        def run(texts: pa.Array) -> pa.Array:
            return pa.array(weights.of(texts))

        return F.arrow_udf(run, "double")(text)


def _ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Both models smoothed towards the raw one, so a bucket that the target has not seen has a finite ratio."""
    p = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    strength = 0.01 * target.sum() + 1
    q = (target + strength * p) / (target.sum() + strength)
    return np.log(q / p)


def _cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold with the fewest errors, a lost good document counting as five; in the middle of its gap."""
    if not len(good) or not len(bad):
        return -math.inf
    edges = np.unique(np.concatenate([good, bad, [0.0]]))
    edges = edges[edges <= 0]
    spots = np.concatenate([[edges[0] - 1], (edges[1:] + edges[:-1]) / 2])
    cost = 5 * np.searchsorted(np.sort(good), spots) + len(bad) - np.searchsorted(np.sort(bad), spots)
    best = np.flatnonzero(cost == cost.min())
    return float(spots[best[len(best) // 2]])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Weights:
    """The weights and the cut, from all documents and a bounded sample of labelled ones."""
    scratch = Scratch(spark, "importance")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)
                    & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    picked = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows of 12 bytes at most
    rows = scratch.keep(texts.join(sample, "doc_id").groupBy("text").agg(F.min("quality").alias("quality"), F.min("doc_id").alias("doc_id"))
                        .select((F.xxhash64("doc_id", F.lit(9)).bitwiseAND(F.lit(1)) == 1).alias("fits"), "quality", "text"))
    target = _model(rows.where("fits and quality = 1").select(F.lit(0).alias("part"), "text"))
    raw = _model(texts.select(F.lit(0).alias("part"), "text"))
    if not target.sum():
        scratch.close()
        return Weights(np.zeros(BUCKETS))
    weights = Weights(_ratio(target, raw))
    judged = rows.where("not fits").select("quality", weights.column(F.col("text")).alias("w")).collect()  # the bounded sample
    weights.cut = _cut(*(np.array([r["w"] for r in judged if r["quality"] == k]) for k in (1, 0)))
    scratch.close()
    return weights


def with_gumbel(log_weight: Column, doc_id: Column, text: Column, temperature: float = TEMPERATURE) -> Column:
    """The sampling key: the log weight plus Gumbel noise, scaled by the temperature."""
    draw = (F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(20)), 11).cast("double") + 0.5) / float(1 << 53)
    return log_weight - temperature * F.log(-F.log(draw))


def kth_largest(scratch: Scratch, keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by histograms of BINS bars that narrow down on it: each pass is one grouped count."""
    keys = keys.select(F.col(column).alias("x"))
    low, high = keys.agg(F.min("x"), F.max("x")).first()
    left = k
    while True:
        inside = keys.where(F.col("x").between(low, high))
        if low == high:
            return low
        width = (high - low) / BINS
        bar = F.least(F.floor((F.col("x") - low) / width), F.lit(BINS - 1)).cast("int")
        bars = sorted(((r["bar"], r["n"], r["least"], r["most"]) for r in inside.groupBy(bar.alias("bar")).agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most")).collect()), reverse=True)
        for _, n, least, most in bars:
            if left <= n:
                low, high = least, most
                break
            left -= n
        if n <= BINS and low < high:
            values = sorted((r[0] for r in inside.where(F.col("x").between(low, high)).collect()), reverse=True)
            return values[left - 1]


def threshold(scratch: Scratch, keys: DataFrame, cut: float) -> float:
    """The smallest key of the sample: k is the number of documents whose log weight reaches the cut."""
    k = keys.where(F.col("log_weight") >= cut).count()
    return kth_largest(scratch, keys, "sample_key", k) if k else math.inf


def resampled(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, sample_key, kept: one row per input row."""
    weights, scratch = fit(spark, docs, labels), Scratch(spark, "resampling")
    text = F.col("text").cast("string")
    rows = scratch.keep(docs.select("doc_id", text.alias("text")).withColumn("log_weight", weights.column(F.col("text")))
                        .select("doc_id", "log_weight", with_gumbel(F.col("log_weight"), F.col("doc_id"), F.col("text")).alias("sample_key")))
    least = threshold(scratch, rows, weights.cut)
    return rows.withColumn("kept", F.col("sample_key") >= F.lit(least))


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sampled documents, with their columns as they are.

    Only ids and keys are written for the threshold; the texts are scored again rather than moved.
    """
    weights, scratch = fit(spark, docs, table(spark, sf_dir, "labels")), Scratch(spark, "resampling")
    weight, key = fresh(docs, "log_weight", "sample_key")
    keyed = (docs.withColumn(weight, weights.column(F.col("text").cast("string")))
             .withColumn(key, with_gumbel(F.col(weight), F.col("doc_id"), F.col("text").cast("string"))))
    rows = scratch.keep(keyed.select(F.col(weight).alias("log_weight"), F.col(key).alias("sample_key")))
    least = threshold(scratch, rows, weights.cut)
    scratch.close()
    return keyed.where(F.col(key) >= F.lit(least)).select(docs.columns)


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample of all ``documents`` in the likeness of the good ones: doc_id, log_weight, sample_key, kept."""
    return resampled(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
