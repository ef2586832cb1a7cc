"""Second-order boosting against a NumPy version that sees all rows at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.forecast import boosting as bo

FEATURES = 3


def brute(x, y, kept, s):
    """(base, splits and leaf values per tree) by scanning every cut of every drawn feature at every node."""
    base = sum(int(np.round(v * bo.UNIT)) for v in y) / len(y) / bo.UNIT
    margin, trees = np.full(len(y), base), []
    for k in range(s.rounds):
        rows, tree = np.flatnonzero(kept[k]), bo.Tree()
        units = np.round((margin - y) * bo.UNIT).astype(np.int64)
        score = lambda at: units[at].sum() / bo.UNIT
        level = [(0, rows)]
        tree.value[0] = -score(rows) / (len(rows) + s.leaf_penalty) * s.rate
        for _ in range(s.depth):
            after = []
            for node, at in level:
                best = None
                for f in bo.drawn_features(s, k, x.shape[1]):
                    for b in sorted(set(x[at, f]))[:-1]:
                        left, right = at[x[at, f] <= b], at[x[at, f] > b]
                        gain = sum(score(p) ** 2 / (len(p) + s.leaf_penalty) for p in (left, right)) - score(at) ** 2 / (len(at) + s.leaf_penalty)
                        if gain / 2 > 1e-12 and (best is None or gain / 2 > best[0] + 1e-15):
                            best = (gain / 2, f, int(b), left, right)
                if best:
                    _, f, b, left, right = best
                    tree.split[node] = (f, b)
                    del tree.value[node]
                    for child, p in ((2 * node + 1, left), (2 * node + 2, right)):
                        tree.value[child] = -score(p) / (len(p) + s.leaf_penalty) * s.rate
                        after.append((child, p))
            level = after
        trees.append(tree)
        margin = margin + np.array([walk(tree, r) for r in x])
    return base, trees, margin


def walk(tree, row):
    at = 0
    while at in tree.split:
        f, b = tree.split[at]
        at = 2 * at + 1 + (row[f] > b)
    return tree.value[at]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.random((160, FEATURES))
    y = np.where(x[:, 0] > 0.5, 0.8, 0.1) + 0.3 * x[:, 1] + 0.01 * rng.standard_normal(160)
    data = [(f"s{i % 7}", i, [float(v) for v in x[i]], float(y[i])) for i in range(160)]
    df = spark.createDataFrame(data, "series_id string, t int, f array<double>, label double")
    return df.withColumn("bins", bo.binned(F.col("f"))).cache(), y


def test_equals_brute_force_at_any_partitioning(spark, rows):
    df, y = rows
    s = bo.Settings(rounds=5, depth=3, rate=0.3)
    kept = df.select("t", "bins", *(bo.drawn_rows(s, k).alias(f"k{k}") for k in range(s.rounds))).orderBy("t").collect()
    x = np.array([r.bins for r in kept])
    base, trees, margin = brute(x, y, [[r[f"k{k}"] for r in kept] for k in range(s.rounds)], s)
    assert 0.7 * 160 < sum(r.k0 for r in kept) < 0.9 * 160
    one, many = (bo.train(df.repartition(n), FEATURES, s) for n in (1, 7))
    assert one == many and one.base == base
    for mine, theirs in zip(one.trees, trees, strict=True):
        assert mine.split == theirs.split and set(mine.value) == set(theirs.value)
        assert all(abs(mine.value[n] - theirs.value[n]) < 1e-12 for n in mine.value)
    got = {r.t: r.p for r in df.select("t", bo.predicted(one, F.col("bins")).alias("p")).collect()}
    assert max(abs(got[i] - margin[i]) for i in range(160)) < 1e-9
    assert np.mean((margin - y) ** 2) < 0.5 * np.var(y)


def test_first_splits_in_sql(spark, rows):
    """The first tree's root by a SQL statement over all rows and cuts."""
    import duckdb

    df, _ = rows
    s = bo.Settings(rounds=1, depth=1, rows=1.0, features=1.0)
    model = bo.train(df, FEATURES, s)
    con = duckdb.connect()
    data = df.select("t", "bins", "label").toPandas()
    con.register("d", data)
    root = con.sql(f"""
        WITH g AS (SELECT t, label, bins, {model.base!r} - label AS g FROM d),
        x AS (SELECT g.g, f, bins[f + 1] AS b FROM g, (SELECT unnest(range({FEATURES})) AS f)),
        c AS (SELECT a.f, a.b, SUM(CASE WHEN x.b <= a.b THEN x.g END) AS gl, SUM(CASE WHEN x.b <= a.b THEN 1 END) AS hl, SUM(x.g) AS g, COUNT(*) AS h
              FROM (SELECT DISTINCT f, b FROM x) a JOIN x ON x.f = a.f GROUP BY 1, 2)
        SELECT f, b FROM c WHERE hl < h ORDER BY gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) DESC, f, b LIMIT 1""").fetchall()[0]
    assert model.trees[0].split[0] == root


def test_constant_and_empty(spark):
    s = bo.Settings(rounds=2, depth=2)
    flat = spark.createDataFrame([("a", i, [1, 2, 3], 0.25) for i in range(9)], "series_id string, t int, bins array<int>, label double")
    model = bo.train(flat, FEATURES, s)
    assert model.base == 0.25 and all(not t.split for t in model.trees)
    assert {round(r.p, 9) for r in flat.select(bo.predicted(model, F.col("bins")).alias("p")).collect()} == {0.25}
    assert bo.train(flat.limit(0), FEATURES, s) == bo.Boosted(0.0, [])


def test_second_order_model_in_a_forecast(spark):
    import datetime as dt

    from shelfline.forecast.run import run_forecast
    series = [(sid, dt.date(2020 + i // 12, i % 12 + 1, 1), 100.0 * (k + 1) + 10 * (i % 4) + i) for k, sid in enumerate("ab") for i in range(24)]
    df = spark.createDataFrame(series, "series_id string, period date, y double")
    fc = run_forecast(df, 2, models=("xgboost",), boost=bo.Settings(rounds=6, rate=0.5))
    future = {(r.series_id, r.step): r.yhat for r in fc.future().collect()}
    assert set(future) == {(s, h) for s in "ab" for h in (1, 2)}
    last = {"a": [p[2] for p in series if p[0] == "a"][-8:], "b": [p[2] for p in series if p[0] == "b"][-8:]}
    assert all(0.6 * min(last[s]) < y < 1.4 * max(last[s]) for (s, _), y in future.items())
    test = [r for r in fc.predictions.where("kind = 'test'").collect()]
    assert test and all(r.yhat is not None for r in test)
