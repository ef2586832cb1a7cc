"""Registered panel-forecast queries.

SQL oracles exist for the parts SQL can express: the series, the panel
set-up (lag length, windows, split, bounds), rejects and the moving-average
hold-out.  Model fits (ridge solve, trees, ARIMA) get rows-only checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..forecast.panel import monthly_series, prepare, rejects, series_info
from ..forecast.run import run_forecast
from ..forecast import models as md
from ..forecast import scoring as sc
from ..oracle import with_roles
from ..registry import register
from .marts import CATS, FACT, PAY

NO_TREES = ("linear_regression", "moving_average", "arima")

_SERIES = {
    "all": "SELECT 'all' AS series_id, CAST(DATE_TRUNC('month', r.rental_date) AS DATE) AS period, "
           "COALESCE(SUM(p.amount), 0) AS rev FROM rental r LEFT JOIN payment p ON p.rental_id = r.rental_id GROUP BY 1, 2",
    "store": f"SELECT CAST(i.store_id AS VARCHAR) AS series_id, CAST(DATE_TRUNC('month', r.rental_date) AS DATE) AS period, "
             f"COALESCE(SUM(p.amount), 0) AS rev {FACT} {PAY} GROUP BY 1, 2",
    "film": f"SELECT CAST(i.film_id AS VARCHAR) AS series_id, CAST(DATE_TRUNC('month', r.rental_date) AS DATE) AS period, "
            f"COALESCE(SUM(p.amount), 0) AS rev {FACT} {PAY} GROUP BY 1, 2",
    "customer": "SELECT CAST(r.customer_id AS VARCHAR) AS series_id, CAST(DATE_TRUNC('month', r.rental_date) AS DATE) AS period, "
                "COALESCE(SUM(p.amount), 0) AS rev FROM rental r LEFT JOIN payment p ON p.rental_id = r.rental_id GROUP BY 1, 2",
}


def _series_cte(by: str) -> str:
    return f", s0 AS ({_SERIES[by]}), s AS (SELECT series_id, period, CAST(rev AS DOUBLE) AS y FROM s0 WHERE rev > 0)"


@register("forecast_series", with_roles(_series_cte("all") + " SELECT * FROM s"))
def q_fc_series(roles):
    return monthly_series(roles, "all")


@register("forecast_series_store", with_roles(_series_cte("store") + " SELECT * FROM s"))
def q_fc_series_store(roles):
    return monthly_series(roles, "store")


_PANEL = """,
c AS (SELECT series_id, COUNT(*) AS n, MIN(y) AS ymin, MAX(y) AS ymax FROM s GROUP BY 1 HAVING COUNT(*) >= 4),
k AS (SELECT *, LEAST(LEAST(GREATEST(3, LEAST(6, n // 2)), n - 2), GREATEST(1, n - 3)) AS k FROM c)
SELECT series_id, CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS k, CAST(n - k AS INTEGER) AS windows,
       CAST(GREATEST(1, LEAST(FLOOR((n - k) * 0.8), n - k - 2)) AS INTEGER) AS train_size,
       CAST(n - k - GREATEST(1, LEAST(FLOOR((n - k) * 0.8), n - k - 2)) AS INTEGER) AS test_size,
       CAST(0.3 AS DOUBLE) * ymin AS lo, CAST(2.5 AS DOUBLE) * ymax AS hi
FROM k"""


def _panel(roles, by):
    info = series_info(prepare(monthly_series(roles, by)))
    return info.select("series_id", "n", "k", "windows", "train_size", "test_size", "lo", "hi")


@register("forecast_panel_store", with_roles(_series_cte("store") + _PANEL))
def q_fc_panel_store(roles):
    return _panel(roles, "store")


@register("forecast_panel_customer", with_roles(_series_cte("customer") + _PANEL))
def q_fc_panel_customer(roles):
    return _panel(roles, "customer")


@register("forecast_panel_film", with_roles(_series_cte("film") + _PANEL))
def q_fc_panel_film(roles):
    """F1 by film: one series per title."""
    return _panel(roles, "film")


@register("forecast_rejects_customer", with_roles(_series_cte("customer") + """
SELECT series_id, COUNT(*) AS n, 'Need at least 4 data points, got ' || CAST(COUNT(*) AS VARCHAR) AS reason
FROM s GROUP BY 1 HAVING COUNT(*) < 4"""))
def q_fc_rejects(roles):
    return rejects(monthly_series(roles, "customer"))


_MA_METRICS = """,
c AS (SELECT series_id, COUNT(*) AS n FROM s GROUP BY 1 HAVING COUNT(*) >= 4),
k AS (SELECT *, LEAST(LEAST(GREATEST(3, LEAST(6, n // 2)), n - 2), GREATEST(1, n - 3)) AS k FROM c),
p AS (SELECT s.series_id, s.y, k.k, k.n,
             CAST(row_number() OVER (PARTITION BY s.series_id ORDER BY s.period) - 1 AS INTEGER) AS t,
             list(s.y) OVER (PARTITION BY s.series_id ORDER BY s.period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS prev
      FROM s JOIN k ON s.series_id = k.series_id),
w AS (SELECT series_id, y, t - k AS i, GREATEST(1, LEAST(FLOOR((n - k) * 0.8), n - k - 2)) AS split,
             list_reduce(list_transform(range(1, k + 1),
                 lambda x: (CAST(x AS DOUBLE) / CAST(k * (k + 1) / 2 AS DOUBLE)) * prev[len(prev) - k + x]),
                 lambda a, b: a + b) AS yhat
      FROM p WHERE t >= k),
te AS (SELECT *, AVG(y) OVER (PARTITION BY series_id) AS ym FROM w WHERE i >= split),
g AS (SELECT series_id, COUNT(*) AS n_test, AVG(ABS(y - yhat)) AS mae, SQRT(AVG((y - yhat) * (y - yhat))) AS rmse,
             AVG(CASE WHEN y <> 0 THEN ABS((y - yhat) / y) END) AS mape,
             SUM((y - yhat) * (y - yhat)) AS ssr, SUM((y - ym) * (y - ym)) AS sst
      FROM te GROUP BY 1)
SELECT series_id, 'moving_average' AS model, n_test, CAST(round_even(TRY_CAST(mae AS DECIMAL(38,9)), 2) AS DOUBLE) AS mae,
       CAST(round_even(TRY_CAST(rmse AS DECIMAL(38,9)), 2) AS DOUBLE) AS rmse,
       CAST(round_even(TRY_CAST(mape * 100 AS DECIMAL(38,9)), 2) AS DOUBLE) AS mape,
       CASE WHEN n_test > 1 THEN CAST(round_even(TRY_CAST(CASE WHEN sst > 0 THEN 1 - ssr / sst ELSE 0.0 END AS DECIMAL(38,9)), 4) AS DOUBLE) END AS r2
FROM g"""


def _ma_metrics(roles, by):
    panel = prepare(monthly_series(roles, by))
    info = series_info(panel)
    return sc.metrics(md.moving_average(panel, info, 3))


@register("forecast_ma_metrics_store", with_roles(_series_cte("store") + _MA_METRICS))
def q_fc_ma_store(roles):
    return _ma_metrics(roles, "store")


@register("forecast_ma_metrics_customer", with_roles(_series_cte("customer") + _MA_METRICS))
def q_fc_ma_customer(roles):
    return _ma_metrics(roles, "customer")


# ---- model-fit queries: rows-only checks
@register("forecast_future_all", None)
def q_fc_future_all(roles):
    return run_forecast(monthly_series(roles, "all"), 3, models=NO_TREES).future()


@register("forecast_trees_all", None)
def q_fc_trees_all(roles):
    """Pooled random forest, decision tree and gradient-boosted trees with the
    reference's hyper-parameters, plus the outlier guard on the boosted model."""
    fc = run_forecast(monthly_series(roles, "all"), 3,
                      models=("random_forest", "decision_tree", "xgboost", "linear_regression"))
    return fc.future()


@register("forecast_leaderboard_store", None)
def q_fc_board_store(roles):
    return run_forecast(monthly_series(roles, "store"), 3, models=NO_TREES).leaderboard


@register("forecast_leaderboard_customer", None)
def q_fc_board_customer(roles):
    return run_forecast(monthly_series(roles, "customer"), 3, models=NO_TREES).leaderboard


@register("forecast_ensemble_store", None)
def q_fc_ens_store(roles):
    return run_forecast(monthly_series(roles, "store"), 6, models=NO_TREES).ensemble


@register("forecast_best_store", None)
def q_fc_best_store(roles):
    return run_forecast(monthly_series(roles, "store"), 3, models=NO_TREES).best()


@register("forecast_comparison_store", None)
def q_fc_cmp_store(roles):
    return run_forecast(monthly_series(roles, "store"), 3, models=NO_TREES).comparison()


@register("forecast_residuals_store", None)
def q_fc_resid_store(roles):
    return run_forecast(monthly_series(roles, "store"), 3, models=NO_TREES).residuals()


@register("forecast_step_changes_store", None)
def q_fc_steps_store(roles):
    return run_forecast(monthly_series(roles, "store"), 3, models=NO_TREES).step_changes()


@register("forecast_arima_orders_store", None)
def q_fc_arima_store(roles):
    out = md.arima(prepare(monthly_series(roles, "store")), 3, with_info=True)
    return out.groupBy("series_id").agg(F.first("order").alias("order"), F.first("aic").alias("aic"),
                                        F.count(F.lit(1)).alias("rows"))


@register("forecast_arima_orders_customer", None)
def q_fc_arima_customer(roles):
    """F14 over one series per customer: chosen order and AIC per series."""
    out = md.arima(prepare(monthly_series(roles, "customer")), 3, with_info=True)
    return out.groupBy("series_id").agg(F.first("order").alias("order"), F.first("aic").alias("aic"),
                                        F.count(F.lit(1)).alias("rows"))


# ---- F17-F28 on predictions that SQL can compute too: the last value and the window's mean enter as external models
# under names of the long-history ones (so penalty and guard apply), beside the weighted moving average.
HORIZON = 3


def _simple_predictions(panel, info):
    """Long-schema predictions: 'transformer' repeats the last value, 'lstm' the mean of the window."""
    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)

    def future(model, value):
        return info.select("series_id", F.lit(model).alias("model"), F.lit("future").alias("kind"),
                           F.explode(F.sequence(F.lit(1), F.lit(HORIZON))).alias("step"), F.lit(None).cast("double").alias("actual"),
                           md.py_round(md.clip(value), 2).alias("yhat"))

    last = F.element_at("win", -1)
    return (md._rows(panel, "transformer", last).unionByName(md._rows(panel, "lstm", mean(F.col("win"))))
            .unionByName(future("transformer", F.col("last_y"))).unionByName(future("lstm", mean(F.col("tail")))))


def _simple_forecast(roles, by="store"):
    series = monthly_series(roles, by)
    panel = prepare(series)
    return run_forecast(series, HORIZON, models=("moving_average",), extra_predictions=_simple_predictions(panel, series_info(panel)))


def _even(x, digits):
    return f"CAST(round_even(TRY_CAST({x} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


_WMA = ("list_reduce(list_transform(range(1, k + 1), lambda x: (CAST(x AS DOUBLE) / CAST(k * (k + 1) / 2 AS DOUBLE)) * {v}[len({v}) - k + x]), "
        "lambda a, b: a + b)")

_SIMPLE = f""",
c AS (SELECT series_id, COUNT(*) AS n, 0.3 * MIN(y) AS lo, 2.5 * MAX(y) AS hi, AVG(y) AS ymean, MAX(period) AS last_period FROM s
      GROUP BY 1 HAVING COUNT(*) >= 4),
k AS (SELECT *, LEAST(LEAST(GREATEST(3, LEAST(6, n // 2)), n - 2), GREATEST(1, n - 3)) AS k FROM c),
p AS (SELECT s.series_id, s.y, s.period, k.k, k.n,
             CAST(row_number() OVER (PARTITION BY s.series_id ORDER BY s.period) - 1 AS INTEGER) AS t,
             list(s.y) OVER (PARTITION BY s.series_id ORDER BY s.period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS prev
      FROM s JOIN k ON s.series_id = k.series_id),
w AS (SELECT *, t - k AS i, GREATEST(1, LEAST(FLOOR((n - k) * 0.8), n - k - 2)) AS split, list_slice(prev, len(prev) - k + 1, len(prev)) AS win
      FROM p WHERE t >= k),
info AS (SELECT k.*, l.tail, l.last_y, l.prev_y FROM k JOIN
         (SELECT series_id, list(y ORDER BY t) FILTER (t >= n - 6) AS tail, MAX(y) FILTER (t = n - 1) AS last_y, MAX(y) FILTER (t = n - 2) AS prev_y
          FROM p GROUP BY 1) l ON k.series_id = l.series_id),
est AS (SELECT series_id, 'transformer' AS model, i, split, y, win[len(win)] AS yhat FROM w
        UNION ALL SELECT series_id, 'lstm', i, split, y, list_sum(win) / len(win) FROM w
        UNION ALL SELECT series_id, 'moving_average', i, split, y, {_WMA.format(v='win')} FROM w),
ma AS (SELECT series_id, 0 AS step, k, lo, hi, tail AS vals FROM info
       UNION ALL
       SELECT series_id, step + 1, k, lo, hi, list_append(vals, {_even("LEAST(GREATEST(" + _WMA.format(v="vals") + ", lo), hi)", 2)})
       FROM ma WHERE step < {HORIZON}),
fut0 AS (SELECT series_id, 'moving_average' AS model, step, vals[len(vals)] AS yhat FROM ma WHERE step > 0
         UNION ALL SELECT series_id, 'lstm', CAST(g AS INTEGER), {_even("LEAST(GREATEST(list_sum(tail) / len(tail), lo), hi)", 2)}
                   FROM info, range(1, {HORIZON + 1}) r(g)
         UNION ALL SELECT series_id, 'transformer', CAST(g AS INTEGER), {_even("LEAST(GREATEST(last_y, lo), hi)", 2)}
                   FROM info, range(1, {HORIZON + 1}) r(g)),
gd AS (SELECT t.series_id, t.step, t.yhat, l.yhat AS cm, info.lo, info.hi,
              MAX(CASE WHEN ABS(t.yhat - l.yhat) > 0.01 * info.ymean THEN 1 ELSE 0 END) OVER (PARTITION BY t.series_id) AS blend
       FROM fut0 t JOIN fut0 l ON t.series_id = l.series_id AND t.step = l.step AND l.model = 'lstm'
       JOIN info ON info.series_id = t.series_id WHERE t.model = 'transformer'),
fut AS (SELECT * FROM fut0 WHERE model <> 'transformer'
        UNION ALL SELECT series_id, 'transformer', step, CASE WHEN blend = 1
          THEN {_even("LEAST(GREATEST(0.6 * yhat + 0.4 * cm, lo), hi)", 2)} ELSE yhat END FROM gd),
te AS (SELECT *, AVG(y) OVER (PARTITION BY series_id, model) AS ym FROM est WHERE i >= split),
g AS (SELECT series_id, model, COUNT(*) AS n_test, AVG(ABS(y - yhat)) AS mae0, SQRT(AVG((y - yhat) * (y - yhat))) AS rmse0,
             AVG(CASE WHEN y <> 0 THEN ABS((y - yhat) / y) END) AS mape0, SUM((y - yhat) * (y - yhat)) AS ssr, SUM((y - ym) * (y - ym)) AS sst
      FROM te GROUP BY 1, 2),
m AS (SELECT series_id, model, {_even("mae0", 2)} AS mae, {_even("rmse0", 2)} AS rmse, {_even("mape0 * 100", 2)} AS mape,
             CASE WHEN n_test > 1 THEN {_even("CASE WHEN sst > 0 THEN 1 - ssr / sst ELSE 0.0 END", 4)} END AS r2 FROM g),
sco AS (SELECT m.*, (0.4 * (mae / 1000) + 0.3 * (COALESCE(rmse, 0) / 1000)
                     + 0.2 * (CASE WHEN mape IS NULL OR mape = 0 THEN 50.0 ELSE mape END / 100) - 0.1 * GREATEST(COALESCE(r2, 0), 0))
               * CASE WHEN model = 'transformer' AND n < 24 THEN 1 + GREATEST(0, (24 - n) / 12.0) ELSE 1 END AS comp0
        FROM m JOIN info ON m.series_id = info.series_id),
board AS (SELECT series_id, model, mae, rmse, mape, r2, {_even("comp0", 4)} AS composite, (r2 < 0) OR (mape > 50) AS underperforming FROM sco),
ens AS (SELECT series_id, step, COUNT(*) AS models, AVG(yhat) AS m, STDDEV_POP(yhat) AS sd FROM fut GROUP BY 1, 2),
ensr AS (SELECT series_id, step, models, {_even("m", 2)} AS ensemble, {_even("m - 1.96 * sd", 2)} AS "lower",
                {_even("m + 1.96 * sd", 2)} AS "upper", {_even("sd", 2)} AS std FROM ens)
"""


def _simple_sql(select, by="store"):
    return with_roles(_series_cte(by) + _SIMPLE + select).replace("WITH ", "WITH RECURSIVE ", 1)


_BOARD = ("SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY composite ASC NULLS LAST, "
          "list_position([" + ", ".join(f"'{m}'" for m in md.MODEL_ORDER) + "], model)) AS rank FROM board")


@register("forecast_simple_leaderboard_store", _simple_sql(_BOARD))
def q_fs_board(roles):
    return _simple_forecast(roles).leaderboard


@register("forecast_simple_leaderboard_customer", _simple_sql(_BOARD, "customer"))
def q_fs_board_customer(roles):
    return _simple_forecast(roles, "customer").leaderboard


@register("forecast_simple_future_store", _simple_sql(
    "SELECT f.series_id, model, CAST(step AS INTEGER) AS step, strftime(last_period + to_months(CAST(step AS INTEGER)), '%Y-%m') AS period, yhat "
    "FROM fut f JOIN info ON f.series_id = info.series_id"))
def q_fs_future(roles):
    """F13 and F15 recursion, F21 guard, F22 labels."""
    return _simple_forecast(roles).future()


@register("forecast_simple_ensemble_store", _simple_sql("SELECT * FROM ensr WHERE models >= 2"))
def q_fs_ensemble(roles):
    return _simple_forecast(roles).ensemble


@register("forecast_simple_residuals_store", _simple_sql(
    f"SELECT series_id, model, CAST(i AS INTEGER) AS \"window\", {_even('y - yhat', 2)} AS residual FROM est WHERE model <> 'moving_average'"))
def q_fs_residuals(roles):
    return _simple_forecast(roles).residuals()


@register("forecast_simple_step_changes_store", _simple_sql(f"""
SELECT series_id, model, step, yhat, CASE WHEN prev <> 0 THEN {_even('(yhat - prev) / ABS(prev) * 100', 2)} ELSE 0.0 END AS delta_pct
FROM (SELECT f.series_id, model, step, yhat,
             COALESCE(LAG(yhat) OVER (PARTITION BY f.series_id, model ORDER BY step), info.last_y) AS prev
      FROM fut f JOIN info ON f.series_id = info.series_id) t"""))
def q_fs_steps(roles):
    return _simple_forecast(roles).step_changes()


@register("forecast_simple_best_store", _simple_sql(f"""
SELECT info.series_id, b.model AS best_model, bf.v AS best_future, {_even('info.last_y', 2)} AS last_revenue, {_even('info.ymean', 2)} AS avg_revenue,
       CASE WHEN info.last_y > info.prev_y THEN 'upward' ELSE 'downward' END AS revenue_trend,
       {_even('(e.ensemble - info.last_y) / info.last_y * 100', 1)} AS ensemble_change_pct, {HORIZON} AS horizon
FROM info JOIN ({_BOARD}) b ON info.series_id = b.series_id AND b.rank = 1
JOIN (SELECT series_id, model, list(yhat ORDER BY step) AS v FROM fut GROUP BY 1, 2) bf ON bf.series_id = info.series_id AND bf.model = b.model
JOIN ensr e ON e.series_id = info.series_id AND e.step = {HORIZON}"""))
def q_fs_best(roles):
    return _simple_forecast(roles).best()


@register("forecast_series_category", with_roles(f""", s0 AS (
  SELECT cat.name AS series_id, CAST(DATE_TRUNC('month', r.rental_date) AS DATE) AS period, COALESCE(SUM(p.amount), 0) AS rev
  {FACT} {CATS} {PAY} GROUP BY 1, 2)
SELECT series_id, period, CAST(rev AS DOUBLE) AS y FROM s0 WHERE rev > 0"""))
def q_fc_series_category(roles):
    return monthly_series(roles, "category")


@register("forecast_trees_store", None)
def q_fc_trees_store(roles):
    """F10-F12 over one series per store."""
    return run_forecast(monthly_series(roles, "store"), 3, models=("random_forest", "decision_tree", "xgboost", "linear_regression")).future()
