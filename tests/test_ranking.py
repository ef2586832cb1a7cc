"""Distributed order statistics against Spark's own single-partition versions."""

import random
from bisect import bisect_left, bisect_right

from pyspark.sql import functions as F

from shelfline.operators.ranking import approximate_quantiles, exact_quantiles, percent_rank, value_ranks


def _data(spark):
    random.seed(7)
    vals = [(i, float(random.choice([0, 0, 0, 1, 2.5, 3, 5, 5, 8]) if i % 3 else random.random() * 50))
            for i in range(3000)]
    return spark.createDataFrame(vals, "id long, v double")


def test_percent_rank_matches_window(spark):
    df = _data(spark)
    df.createOrReplaceTempView("pr_t")
    ref = spark.sql("SELECT id, percent_rank() OVER (ORDER BY v) AS p FROM pr_t")
    ours = percent_rank(df, "v", ranges=8)
    bad = ours.join(ref, "id").where(F.abs(F.col("pct_rank") - F.col("p")) > 1e-12).count()
    assert bad == 0


def test_exact_quantiles_match_percentile(spark):
    df = _data(spark)
    df.createOrReplaceTempView("q_t")
    q = exact_quantiles(df, "v", [1 / 3, 2 / 3], ranges=8).collect()[0]
    ref = spark.sql("SELECT percentile(v, array(1/3, 2/3)) AS e FROM q_t").collect()[0].e
    assert abs(q.q0 - ref[0]) < 1e-9 and abs(q.q1 - ref[1]) < 1e-9


def test_carried_sums_hot_values_and_few_rows(spark):
    rows = [(i, 1.5 if i % 3 else None if i % 2 else float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = {r.v: (r.cnt, r.id, r.below, r.n) for r in value_ranks(df, "v", ranges=50, sums=["id"]).collect()}
    values = sorted(v for _, v in rows if v is not None)
    assert got == {v: (values.count(v), sum(i for i, w in rows if w == v), values.index(v), len(values)) for v in set(values)}
    for few in ([], [(1, None)], [(1, 2.0)], [(1, 2.0), (2, 2.0)]):
        q = exact_quantiles(spark.createDataFrame(few, "id long, v double"), "v", [0.5]).collect()[0]
        kept = [v for _, v in few if v is not None]
        assert q.q0 == (kept[0] if kept else None) and q.n == (len(kept) or None)


def test_plan_shares_the_range_exchange(spark):
    df = _data(spark)
    ranked = value_ranks(df, "v")
    ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    ranges = [line for line in plan.split("\n") if "Exchange rangepartitioning" in line]
    assert len(ranges) == 2 and sum("ReusedExchange" in line for line in ranges) == 1
    assert "sort_array" not in plan and "SinglePartition, REPARTITION" not in plan


def test_sketch_quantiles_keep_their_rank(spark):
    rng = random.Random(9)
    values = sorted(rng.choice([rng.gauss(0, 1) ** 3, 5.0]) for _ in range(40_000))
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(7)
    probs = [0.01, 1 / 3, 0.5, 2 / 3, 0.99]
    q = approximate_quantiles(df, "v", probs).collect()[0]
    assert (q.vmin, q.vmax, q.n) == (values[0], values[-1], len(values))
    for i, p in enumerate(probs):
        low, high = bisect_left(values, q[f"q{i}"]) / len(values), bisect_right(values, q[f"q{i}"]) / len(values)
        assert low - 0.002 <= p <= high + 0.002
    assert tuple(approximate_quantiles(df.limit(0), "v", [0.5]).collect()[0]) == (None, None, None, None)
