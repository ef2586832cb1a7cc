"""Forecast cases (FIXTURES.md section 4) and NumPy re-computations."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.forecast import ensemble as en
from shelfline.forecast import scoring as sc
from shelfline.forecast.panel import clamp_horizon, future_labels, lag_length, prepare, series_info
from shelfline.forecast.run import run_forecast

DIAG = [1000, 1200, 1500, 1300, 1400, 1600, 1800, 1700, 1900, 2100, 2300, 2200, 2400]


def series_df(spark, sid, values, start=(2024, 1)):
    y0, m0 = start
    rows = [(sid, dt.date(y0 + (m0 - 1 + i) // 12, (m0 - 1 + i) % 12 + 1, 1), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, period date, y double")


def test_lag_length(spark):
    df = spark.createDataFrame([(n,) for n in (4, 5, 6, 9, 12, 13)], "n int")
    assert [r.k for r in df.select(lag_length(F.col("n")).alias("k")).collect()] == [1, 2, 3, 4, 6, 6]


def test_horizon_clamp():
    assert (clamp_horizon(0), clamp_horizon(3), clamp_horizon(9), clamp_horizon("x")) == (1, 3, 6, 3)


def test_diagnostic_panel(spark):
    info = series_info(prepare(series_df(spark, "d", DIAG))).collect()[0]
    assert (info.n, info.k, info.windows, info.train_size, info.test_size) == (13, 6, 7, 5, 2)
    assert (info.lo, info.hi) == (300.0, 6000.0)


def test_too_short_rejected(spark):
    fc = run_forecast(series_df(spark, "s", [5, 6, 7]), 3, models=("moving_average",))
    assert [r.series_id for r in fc.rejects.collect()] == ["s"]


def test_weighted_average_and_ridge_match_numpy(spark):
    fc = run_forecast(series_df(spark, "d", DIAG), 3, models=("linear_regression", "moving_average"))
    fut = {(r.model, r.step): r.yhat for r in fc.future().collect()}
    y = np.array(DIAG, float)
    k = 6
    x = np.array([y[i:i + k] for i in range(len(y) - k)])
    xt, yt = x[:5], y[k:][:5]
    xm, ym = xt.mean(0), yt.mean()
    w = np.linalg.solve((xt - xm).T @ (xt - xm) + np.eye(k), (xt - xm).T @ (yt - ym))
    b = ym - xm @ w
    hist, out = list(y), []
    for _ in range(3):
        p = b + np.dot(w, hist[-k:])
        out.append(round(float(np.clip(p, 300, 6000)), 2))
        hist.append(p)
    assert [fut[("linear_regression", s)] for s in (1, 2, 3)] == pytest.approx(out, abs=0.011)
    wts = np.arange(1, k + 1) / np.arange(1, k + 1).sum()
    ma = list(y)
    exp = []
    for _ in range(3):
        p = round(float(np.clip(np.dot(wts, ma[-k:]), 300, 6000)), 2)
        exp.append(p)
        ma.append(p)
    assert [fut[("moving_average", s)] for s in (1, 2, 3)] == exp


def test_weighted_average_first_step(spark):
    fc = run_forecast(series_df(spark, "w", [10, 20, 30, 40, 50, 60]), 1, models=("moving_average",))
    # n = 6 -> k = 3: (1*40 + 2*50 + 3*60) / 6
    assert fc.future().collect()[0].yhat == 53.33


def _preds(spark, rows):
    return spark.createDataFrame(rows, "series_id string, model string, kind string, step int, actual double, yhat double")


def test_metrics_case(spark):
    p = _preds(spark, [("a", "m", "test", 0, 0.0, 1.0), ("a", "m", "test", 1, 10.0, 8.0)])
    r = sc.metrics(p).collect()[0]
    assert (r.mae, r.rmse, r.mape, r.r2) == (1.5, 1.58, 20.0, 0.9)


def test_constant_actuals_r2_zero(spark):
    p = _preds(spark, [("a", "m", "test", 0, 5.0, 4.0), ("a", "m", "test", 1, 5.0, 6.0)])
    assert sc.metrics(p).collect()[0].r2 == 0.0


def test_ensemble_band_and_single_model(spark):
    p = _preds(spark, [("a", "x", "future", 1, None, 10.0), ("a", "y", "future", 1, None, 14.0),
                       ("b", "x", "future", 1, None, 10.0)])
    rows = {r.series_id: r for r in en.ensemble(p, 1).collect()}
    assert set(rows) == {"a"}
    assert (rows["a"].ensemble, rows["a"].std, rows["a"].lower, rows["a"].upper) == (12.0, 2.0, 8.08, 15.92)


def test_small_sample_penalty(spark):
    m = spark.createDataFrame([("a", "transformer", 2, 100.0, 100.0, 10.0, 0.5)],
                              "series_id string, model string, n_test long, mae double, rmse double, mape double, r2 double")
    n = spark.createDataFrame([("a", 9)], "series_id string, n int")
    c = sc.leaderboard(m, n).collect()[0].composite
    base = 0.4 * 0.1 + 0.3 * 0.1 + 0.2 * 0.1 - 0.1 * 0.5
    assert c == pytest.approx(round(base * 2.25, 4))


def test_mape_zero_quirk_and_strict_flag(spark):
    m = spark.createDataFrame([("a", "arima", 2, 0.0, 0.0, 0.0, 1.0)],
                              "series_id string, model string, n_test long, mae double, rmse double, mape double, r2 double")
    n = spark.createDataFrame([("a", 30)], "series_id string, n int")
    assert sc.leaderboard(m, n, strict_compat=True).collect()[0].composite == pytest.approx(0.1 - 0.1)
    assert sc.leaderboard(m, n, strict_compat=False).collect()[0].composite == pytest.approx(-0.1)


def test_calendar_labels(spark):
    info = spark.createDataFrame([("a", dt.date(2005, 12, 1))], "series_id string, last_period date")
    got = [r.period for r in future_labels(info, 3).orderBy("step").collect()]
    assert got == ["2006-01", "2006-02", "2006-03"]


def test_arima_runs_and_stays_in_bounds(spark):
    fc = run_forecast(series_df(spark, "d", DIAG), 3, models=("arima",))
    fut = [r.yhat for r in fc.future().collect()]
    assert len(fut) == 3 and all(300 <= v <= 6000 for v in fut)


def test_guard_keeps_forecasts_without_candidates(spark):
    preds = spark.createDataFrame(
        [("a", "xgboost", "future", k, None, 100.0 + k) for k in (1, 2)] + [("a", "arima", "future", k, None, 1.0) for k in (1, 2)]
        + [("b", "xgboost", "future", k, None, 1000.0) for k in (1, 2)] + [("b", "linear_regression", "future", 1, None, 10.0)]
        + [("c", "xgboost", "future", 1, None, 5.0)],
        "series_id string, model string, kind string, step int, actual double, yhat double")
    info = spark.createDataFrame([("a", 50.0, 0.0, 500.0), ("b", 50.0, 0.0, 500.0)], "series_id string, ymean double, lo double, hi double")
    got = {(r.series_id, r.model, r.step): r.yhat for r in en.guard(preds, info).collect()}
    assert len(got) == 8
    assert got["a", "xgboost", 1] == 101.0 and got["a", "xgboost", 2] == 102.0 and got["c", "xgboost", 1] == 5.0
    # one step of b deviates from its candidate and is blended; the other has no candidate and stays
    assert got["b", "xgboost", 1] == 500.0 and got["b", "xgboost", 2] == 1000.0
