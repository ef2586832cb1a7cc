"""Forecast models over a prepared panel.

Every model returns the same long table::

    series_id, model, kind ('fit' | 'test' | 'future'), step, actual, yhat

``fit`` rows are in-sample predictions for every window (F16), ``test`` rows the
hold-out predictions scored by F17, ``future`` rows the rounded, clipped
forecasts (step 1..h).  What is fed back in the recursive forecast follows the
reference per model (F15): ridge and trees feed back the unclipped value, the
moving average its rounded clipped value.

* ridge (F9): per-series closed form from grouped sufficient statistics
  (sums over the training windows, computed by Spark), then a k<=6 solve per
  series in a tiny ``mapInPandas`` over one row per series.
* moving average (F13): native array expressions, no UDF.
* trees (F10-F12): pooled over the panel on min-max scaled lags: random forest and decision tree with
  ``pyspark.ml``, boosting with it or, second order, as grouped aggregates (:mod:`.boosting`).
* ARIMA (F14): one row of values per series, batches of series through numpy
  in ``mapInPandas``; Hannan-Rissanen estimation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import py_round
from ..session import cut
from . import boosting
from .panel import MAX_LAGS, clip, scaled, unscaled

PRED_SCHEMA = "series_id string, model string, kind string, step int, actual double, yhat double"

# Model names and their order of listing (ties in the leaderboard
# keep this order).
MODEL_ORDER = ["transformer", "lstm", "random_forest", "decision_tree", "linear_regression",
               "moving_average", "xgboost", "arima"]


def _lag(j: int):
    """j-th most recent value of the window (0 when the window is shorter)."""
    return F.coalesce(F.try_element_at(F.col("win"), F.lit(-j)), F.lit(0.0))


def _rows(panel: DataFrame, model: str, yhat, info_cols=()) -> DataFrame:
    w = panel.where(F.col("win").isNotNull())
    fit = w.select("series_id", F.lit(model).alias("model"), F.lit("fit").alias("kind"),
                   F.col("i").alias("step"), F.col("y").alias("actual"), yhat.alias("yhat"))
    test = w.where("is_test").select("series_id", F.lit(model).alias("model"), F.lit("test").alias("kind"),
                                     (F.col("i") - F.col("split")).alias("step"), F.col("y").alias("actual"),
                                     yhat.alias("yhat"))
    return fit.unionByName(test)


def _future(info: DataFrame, model: str, preds_col, horizon: int, start_at_tail: bool = True) -> DataFrame:
    """Explode an array of ``horizon`` future values into rounded clipped rows."""
    vals = F.slice(preds_col, F.size("tail") + 1, horizon) if start_at_tail else preds_col
    return (info.select("series_id", "lo", "hi", F.posexplode(vals).alias("pos", "p"))
            .select("series_id", F.lit(model).alias("model"), F.lit("future").alias("kind"),
                    (F.col("pos") + 1).cast("int").alias("step"), F.lit(None).cast("double").alias("actual"),
                    py_round(clip(F.col("p")), 2).alias("yhat")))


# ----------------------------------------------------------------------------- ridge
def _ridge_solve(alpha: float):
    def solve(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            n = pdf["cnt"].to_numpy(float)
            sx = np.stack([pdf[f"sx{a}"].to_numpy(float) for a in range(1, MAX_LAGS + 1)], axis=1)
            sy = pdf["sy"].to_numpy(float)
            sxx = np.empty((len(pdf), MAX_LAGS, MAX_LAGS))
            for a in range(1, MAX_LAGS + 1):
                for b in range(a, MAX_LAGS + 1):
                    v = pdf[f"sxx{a}_{b}"].to_numpy(float)
                    sxx[:, a - 1, b - 1] = v
                    sxx[:, b - 1, a - 1] = v
            sxy = np.stack([pdf[f"sxy{a}"].to_numpy(float) for a in range(1, MAX_LAGS + 1)], axis=1)
            xm = sx / n[:, None]
            ym = sy / n
            # centred normal equations: (Xc'Xc + alpha I) w = Xc'yc; intercept unpenalised
            a_mat = sxx - n[:, None, None] * xm[:, :, None] * xm[:, None, :] + alpha * np.eye(MAX_LAGS)
            rhs = sxy - n[:, None] * xm * ym[:, None]
            w = np.linalg.solve(a_mat, rhs[:, :, None])[:, :, 0]
            b = ym - np.einsum("ij,ij->i", xm, w) + pdf["at"].to_numpy(float) * (1 - w.sum(axis=1))
            out = pd.DataFrame({"series_id": pdf["series_id"], "b": b})
            for a in range(MAX_LAGS):
                out[f"w{a + 1}"] = w[:, a]
            yield out
    return solve


def ridge(panel: DataFrame, info: DataFrame, horizon: int, alpha: float = 1.0) -> DataFrame:
    lags = {j: _lag(j) for j in range(1, MAX_LAGS + 1)}
    train = panel.where("is_train")
    # sums of deviations from the series' mean: money-sized raw sums would lose the digits next to alpha
    dev, y = {j: c - F.col("ymean") for j, c in lags.items()}, F.col("y") - F.col("ymean")
    aggs = [F.count(F.lit(1)).cast("double").alias("cnt"), F.sum(y).alias("sy"), F.first("ymean").alias("at")]
    aggs += [F.sum(dev[a]).alias(f"sx{a}") for a in lags]
    aggs += [F.sum(dev[a] * dev[b]).alias(f"sxx{a}_{b}") for a in lags for b in lags if b >= a]
    aggs += [F.sum(dev[a] * y).alias(f"sxy{a}") for a in lags]
    stats = train.groupBy("series_id").agg(*aggs)
    coef_schema = "series_id string, b double, " + ", ".join(f"w{a} double" for a in lags)
    coef = stats.mapInPandas(_ridge_solve(alpha), coef_schema)
    pw = panel.join(coef, "series_id")
    yhat = F.col("b")
    for j in lags:
        yhat = yhat + F.col(f"w{j}") * lags[j]
    rows = _rows(pw, "linear_regression", yhat)

    def step(acc, _):
        p = F.col("b")
        for j in lags:
            p = p + F.col(f"w{j}") * F.coalesce(F.try_element_at(acc, F.lit(-j)), F.lit(0.0))
        return F.concat(acc, F.array(p))
    iw = info.join(coef, "series_id")
    preds = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("tail"), step)
    return rows.unionByName(_future(iw, "linear_regression", preds, horizon))


# ----------------------------------------------------------------------------- moving average
def _wma(arr, k):
    """sum_{i=1..k} (i / S) * arr[i] over the last k values (oldest first), S = k(k+1)/2."""
    last = F.slice(arr, -k, k)
    s = k * (k + 1) / 2
    return F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0),
                       lambda acc, i: acc + (i.cast("double") / s.cast("double")) * F.element_at(last, i))


def moving_average(panel: DataFrame, info: DataFrame, horizon: int) -> DataFrame:
    w = panel.where(F.col("win").isNotNull())
    test = w.where("is_test").select("series_id", F.lit("moving_average").alias("model"), F.lit("test").alias("kind"),
                                     (F.col("i") - F.col("split")).alias("step"), F.col("y").alias("actual"),
                                     _wma(F.col("win"), F.col("k")).alias("yhat"))
    k = F.col("k")

    def step(acc, _):
        return F.concat(acc, F.array(py_round(clip(_wma(acc, k)), 2)))
    preds = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("tail"), step)
    return test.unionByName(_future(info, "moving_average", preds, horizon))


# ----------------------------------------------------------------------------- pooled trees
def _lags(vals, k):
    """Lag features (most recent first, 0 beyond k), scaled by what the training windows show."""
    return [F.when(F.lit(j) <= k, scaled(F.coalesce(F.try_element_at(vals, F.lit(-j)), F.col("tmin")), "tmin", "tmax"))
            .otherwise(F.lit(0.0)) for j in range(1, MAX_LAGS + 1)]


def _features(vals, k):
    """The lags and k itself, as MLlib takes them."""
    from pyspark.ml.functions import array_to_vector
    return array_to_vector(F.array(*_lags(vals, k), k.cast("double")))


def _bins(vals, k):
    """The same, binned for boosting; k on a scale of 0 to 1."""
    return boosting.binned(F.array(*_lags(vals, k), k / F.lit(MAX_LAGS + 2.0)))


def tree_models(panel: DataFrame, info: DataFrame, horizon: int, kinds=("random_forest", "decision_tree", "xgboost"),
                seed: int = 42, partitions: int = 8, boost: boosting.Settings | None = None) -> DataFrame:
    """F10-F12.  MLlib draws its samples per partition, so its fitted trees depend on the partitioning: it is a hash of
    the series into ``partitions`` (a parameter of the model, to be raised with the panel) in a fixed order, never a
    function of the rows or the cluster's cores.  With ``boost`` the boosted model is the second-order one with these
    settings (``boosting.Settings()`` are the original's), which draws by hash and does not depend on the partitioning; it takes
    rounds x depth small Spark jobs, some minutes of scheduling at 200 rounds, so MLlib's first-order one is the default."""
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
    w = panel.where(F.col("win").isNotNull()).withColumn("label", scaled(F.col("y"), "tmin", "tmax"))
    # iterative learners re-read their input every round: cut the lineage once.
    # The table is one row per training window (series x months), a bounded panel.
    train = cut(w.where("is_train").repartition(partitions, "series_id").sortWithinPartitions("series_id", "t")
                .select("series_id", "t", _features(F.col("win"), F.col("k")).alias("features"), _bins(F.col("win"), F.col("k")).alias("bins"), "label"))

    def forest(estimator):
        model = estimator.fit(train.select("features", "label"))
        return lambda df, vals: model.transform(df.withColumn("features", _features(vals, F.col("k")))).drop("features")

    def boosted():
        if boost is None:
            return forest(GBTRegressor(maxIter=200, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed))
        model = boosting.train(train, MAX_LAGS + 1, boost)
        return lambda df, vals: df.withColumn("prediction", boosting.predicted(model, _bins(vals, F.col("k"))))

    makers = {
        "random_forest": lambda: forest(RandomForestRegressor(numTrees=200, maxDepth=6, featureSubsetStrategy="all", seed=seed)),
        "decision_tree": lambda: forest(DecisionTreeRegressor(maxDepth=4, seed=seed)),
        "xgboost": boosted,
    }
    out = None
    for name in kinds:
        predict = makers[name]()
        scored = predict(w, F.col("win")).withColumn("yhat", unscaled(F.col("prediction"), "tmin", "tmax"))
        rows = _rows(scored, name, F.col("yhat"))
        # recursive forecast, feeding back the unclipped prediction
        state = info.withColumn("vals", F.col("tail")).withColumn("outs", F.array().cast("array<double>"))
        for _ in range(horizon):
            state = (predict(state, F.col("vals"))
                     .withColumn("p", unscaled(F.col("prediction"), "tmin", "tmax"))
                     .withColumn("vals", F.concat("vals", F.array("p")))
                     .withColumn("outs", F.concat("outs", F.array("p")))
                     .drop("prediction", "p"))
        fut = _future(state, name, F.col("outs"), horizon, start_at_tail=False)
        part = rows.unionByName(fut)
        out = part if out is None else out.unionByName(part)
    return out


# ----------------------------------------------------------------------------- ARIMA
def _ols(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares for a handful of regressors: normal equations, lstsq if singular."""
    xtx = x.T @ x
    try:
        return np.linalg.solve(xtx, x.T @ y)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(x, y, rcond=None)[0]


def _stable(coefs: np.ndarray) -> bool:
    """Roots of 1 - c1 z - c2 z^2 ... outside the unit circle (stationary / invertible)."""
    if len(coefs) == 0:
        return True
    if len(coefs) == 1:
        return abs(coefs[0]) < 1.0 - 1e-6
    if len(coefs) == 2:  # stationarity triangle of an order-2 polynomial
        c1, c2 = coefs
        return bool(c1 + c2 < 1.0 - 1e-6 and c2 - c1 < 1.0 - 1e-6 and abs(c2) < 1.0 - 1e-6)
    roots = np.roots(np.r_[-coefs[::-1], 1.0])
    return bool(np.all(np.abs(roots) > 1.0 + 1e-6))


MAX_ORDER = 2


def _stage1(z: np.ndarray):
    """Long-AR innovations shared by every (p, q) of one series (Hannan-Rissanen stage 1)."""
    nz = len(z)
    m = max(2 * MAX_ORDER, 2)
    if nz - m < m + 1:
        m = max(1, (nz - 1) // 2)
    if m < 1 or nz - m < m + 1:
        return None
    xl = np.column_stack([z[m - j - 1:nz - j - 1] for j in range(m)])
    a = _ols(xl, z[m:])
    e = np.zeros(nz)
    e[m:] = z[m:] - xl @ a
    return e, m


def _stage2(z: np.ndarray, e: np.ndarray, m: int, p: int, q: int):
    """ARMA(p, q) on differences z with innovations e, no constant; every order is
    estimated on the same sample (from m + MAX_ORDER) so AICs compare.
    Returns (phi, theta, resid, aic) or None (too short, or not stationary/invertible)."""
    nz = len(z)
    r = m + MAX_ORDER
    nobs = nz - r
    if nobs < p + q + 2:
        return None
    target = z[r:]
    if p + q:
        x = np.column_stack([z[r - j - 1:nz - j - 1] for j in range(p)] + [e[r - j - 1:nz - j - 1] for j in range(q)])
        beta = _ols(x, target)
        resid = target - x @ beta
    else:
        beta = np.zeros(0)
        resid = target
    phi, theta = beta[:p], beta[p:]
    if not (_stable(phi) and _stable(-theta)):
        return None
    sigma2 = float(np.mean(resid ** 2))
    if not np.isfinite(sigma2) or sigma2 <= 0:
        return None
    aic = nobs * (np.log(2 * np.pi * sigma2) + 1) + 2 * (p + q + 1)
    full_e = e.copy()
    full_e[r:] = resid
    return phi, theta, full_e, aic


def _hr_fit(y: np.ndarray, p: int, q: int):
    z = np.diff(y)
    s1 = _stage1(z)
    return None if s1 is None else _stage2(z, s1[0], s1[1], p, q)


def _hr_forecast(y: np.ndarray, p: int, q: int, steps: int):
    fit = _hr_fit(y, p, q)
    if fit is None:
        return None
    phi, theta, e, _ = fit
    z = list(np.diff(y))
    ee = list(e)
    out = []
    level = float(y[-1])
    for _ in range(steps):
        zn = sum(phi[j] * z[-j - 1] for j in range(p)) + sum(theta[j] * ee[-j - 1] for j in range(q))
        z.append(zn)
        ee.append(0.0)
        level += zn
        out.append(level)
    return np.array(out)


def _arima_series(sid, y, lo, hi, n_test, horizon, rows):
    """Order search on the full series, hold-out refit, full-data forecast."""
    best_aic, best = np.inf, (1, 1)
    z = np.diff(y)
    s1 = _stage1(z)
    if s1 is not None:
        for p in range(MAX_ORDER + 1):
            for q in range(MAX_ORDER + 1):
                f = _stage2(z, s1[0], s1[1], p, q)
                if f is not None and f[3] < best_aic:
                    best_aic, best = f[3], (p, q)
    order = f"({best[0]}, 1, {best[1]})"
    aic = round(float(best_aic), 2) if np.isfinite(best_aic) else None
    if n_test > 0 and len(y) > n_test + 2:
        fc = _hr_forecast(y[:-n_test], best[0], best[1], n_test)
        if fc is not None:
            fc = np.clip(fc, lo, hi)
            for s in range(n_test):
                rows.append((sid, "arima", "test", s, float(y[len(y) - n_test + s]), float(fc[s]), order, aic))
    fc = _hr_forecast(y, best[0], best[1], horizon)
    if fc is not None and np.all(np.isfinite(fc)):
        for s in range(horizon):
            rows.append((sid, "arima", "future", s + 1, None, round(float(np.clip(fc[s], lo, hi)), 2), order, aic))


def _arima_batches(horizon: int):
    cols = ["series_id", "model", "kind", "step", "actual", "yhat", "order", "aic"]

    def run(batches):
        for pdf in batches:
            rows = []
            for sid, ys, lo, hi, n_test in zip(pdf["series_id"], pdf["ys"], pdf["lo"], pdf["hi"], pdf["n_test"]):
                try:
                    _arima_series(sid, np.asarray(ys, dtype=float), float(lo), float(hi), int(n_test), horizon, rows)
                except (np.linalg.LinAlgError, ValueError):
                    continue  # a series that cannot be fitted gets no ARIMA rows
            yield pd.DataFrame(rows, columns=cols)
    return run


def arima(panel: DataFrame, horizon: int, with_info: bool = False) -> DataFrame:
    """F14 per series.  Each series becomes one row holding its (bounded) monthly
    values; Arrow batches of many series go through numpy in ``mapInPandas``."""
    per = panel.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("t", "y"))).alias("_pts"),
        F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        (F.first("m") - F.first("split")).alias("n_test"))
    per = per.select("series_id", F.transform("_pts", lambda x: x.getField("y")).alias("ys"), "lo", "hi", "n_test")
    res = per.mapInPandas(_arima_batches(horizon), PRED_SCHEMA + ", order string, aic double")
    return res if with_info else res.drop("order", "aic")
