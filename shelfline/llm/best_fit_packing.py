"""Packing of tokenized documents into sequences by minimum bin slack.

Documents become token ids and an end id; longer ones are cut into pieces of the capacity, of which the first may be
shorter: the rest of the division comes first, all later pieces are full.  What fills a bin best
depends on lengths alone, and there are at most ``capacity`` of them, so the plan is made from their histogram:
the largest length left opens a bin, a bitset subset-sum over the lengths left (each as often as it is left) finds
the fullest combination that fits, and the combination is taken as often as the counts allow, which makes as many
equal bins at once.  Each round uses up at least one length's copies of a combination, so the plan is short
whatever the number of documents.  Spark numbers the pieces of each length without gaps and joins number ranges to
the plan's bins; the plan (at most some tens of thousands of short rows) is all that is broadcast.

Defined results: a null or empty text is the end id alone.  Repeated rows are packed like any others.  Equal
lengths are numbered by doc_id and piece; a null doc_id comes first.  An empty table packs to an empty result.
Texts are packed whole.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, numbered, table
from .pretokens import encoder, vocabulary

CAPACITY, END = 1024, 2


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each document."""
    path = vocabulary(path)
    end = _packed([END])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, "ids", _packed)
        names = ["piece", "start", "length", "ids_crc32"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, out = [], []
                for i, parts in enumerate(ids_of.encode(batch.column(1).slice(at, 256).to_pylist())):
                    ids = memoryview(b"".join([*parts, end]))
                    n = len(ids) // 4
                    for k, end_at in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        start = max(0, end_at - capacity)
                        piece = ids[4 * start:4 * end_at]
                        rows.append(i)
                        out.append((k, start, end_at - start, zlib.crc32(piece)))
                owner = batch.column(0).slice(at, 256).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([owner, *(pa.array([x[k] for x in out], pa.int32() if k == 0 else pa.int64()) for k in range(4))],
                                                 names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], slack: int) -> dict[int, int]:
    """The copies of each length, none more often than it is left, with the greatest total within the slack."""
    mask, reach, layers = (1 << (slack + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= slack), reverse=True):
        layers.append((length, reach))
        left, step = min(counts[length], slack // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & mask
            left, step = left - step, 2 * step
        if reach >> slack & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        copies = 0
        while not before >> (total - copies * length) & 1:
            copies += 1
        if copies:
            used[length] = copies
            total -= copies * length
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, bins, copies a bin, offset, first sequence) of each length in each kind of bin."""
    left, taken, out, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        largest = max(left)
        left[largest] -= 1
        used = fullest({x: n for x, n in left.items() if n}, capacity - largest)
        left[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        bins, offset = min(left[x] // n for x, n in used.items()), 0
        for length in sorted(used, reverse=True):
            copies = used[length]
            out.append((length, taken[length], bins, copies, offset, sequence))
            offset += copies * length
            taken[length] += bins * copies
            left[length] -= bins * copies
            if not left[length]:
                del left[length]
        sequence += bins
    return out


def packed(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    scratch = Scratch(spark, "packing")
    rows = scratch.keep(pieces(docs, capacity, path))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    bins = spark.createDataFrame(plan(histogram, capacity),
                                 "length long, first long, bins long, copies long, at long, sequence long")
    number = F.col("number") - F.col("first")
    inside = (F.col("number") >= F.col("first")) & (number < F.col("bins") * F.col("copies"))
    return (numbered(rows, ["length"], ["doc_id", "piece"], "number").join(F.broadcast(bins), "length").where(inside)
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + number % F.col("bins")).alias("sequence_id"),
                    (F.col("at") + F.floor(number / F.col("bins")).cast("long") * F.col("length")).alias("offset")))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of the documents."""
    return packed(spark, docs)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 1024 tokens."""
    return packed(spark, table(spark, sf_dir, "documents"))
