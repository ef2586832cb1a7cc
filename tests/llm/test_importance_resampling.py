import random
from collections import Counter

from pyspark.sql import functions as F

from shelfline.llm.common import Scratch
from shelfline.llm.importance_resampling import good_only, kth_largest, resampled


def corpus(vocabulary, n=900):
    rng = random.Random(2)
    small = vocabulary[:150]
    rows, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        w = [rng.choice(small) for _ in range(80)]
        rows.append((i, " ".join(w) if good else " ".join(x + "%%%" for x in w)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_and_edges(spark, frame, vocabulary, tmp_path):
    rows, labels = corpus(vocabulary)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = [(5000, None), (5001, ""), (None, rows[1][1]), (5002, rows[0][1]), (5002, rows[0][1])]
    docs = frame(rows + extra)
    got = resampled(spark, docs, known).collect()
    truth = {i: bool(q) for i, q, _ in labels} | {5000: True, 5001: True, None: True, 5002: False}
    wrong = [r.doc_id for r in got if r.kept != truth[r.doc_id]]
    assert len(got) == len(rows) + len(extra) and len(wrong) <= 0.02 * len(rows)
    assert {r.log_weight for r in got if r.doc_id in (5000, 5001)} == {0.0}
    assert len({(r.sample_key, r.kept) for r in got if r.doc_id == 5002}) == 1  # repeated rows fall together
    known.write.parquet(str(tmp_path / "labels.parquet"))
    kept = good_only(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_kth_largest_is_exact(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 10) ** 3 for _ in range(5000)] + [7.0] * 3000
    df = spark.createDataFrame([(v,) for v in values], "x double")
    scratch = Scratch(spark, "test")
    ordered = sorted(values, reverse=True)
    for k in (1, 17, 2500, 4100, len(values)):
        assert kth_largest(scratch, df, "x", k) == ordered[k - 1]


def test_empty_and_unlabelled(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resampled(spark, frame([]), none).collect() == []
    assert resampled(spark, frame([(1, "some text"), (2, None)]), none).where(F.col("kept")).count() == 2
