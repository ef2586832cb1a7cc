"""Hold-out metrics, composite score and leaderboard.

Rounding follows Python's ``round`` (half-even on the binary value) via
``py_round`` (half-even through the 9-decimal value): MAE, RMSE, MAPE to 2
places, R² to 4, composite to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import py_round
from .models import MODEL_ORDER

# Models that need long histories (small-sample penalty) — the
# reference's deep models.  External predictions under these names get the penalty.
DATA_HUNGRY = ["transformer"]


def metrics(preds: DataFrame) -> DataFrame:
    """F17 per (series, model) over the 'test' rows: mae, rmse, mape (zero actuals
    skipped, null when none), r2 (0 when the actuals do not vary, null for n <= 1)."""
    t = preds.where(F.col("kind") == "test")
    g = Window.partitionBy("series_id", "model")
    t = t.withColumn("_mean", F.avg("actual").over(g))
    err = F.col("actual") - F.col("yhat")
    agg = t.groupBy("series_id", "model").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(F.abs(err)).alias("_mae"),
        F.sqrt(F.avg(err * err)).alias("_rmse"),
        F.avg(F.when(F.col("actual") != 0, F.abs(err / F.col("actual")))).alias("_mape"),
        F.sum(err * err).alias("_ssr"),
        F.sum((F.col("actual") - F.col("_mean")) * (F.col("actual") - F.col("_mean"))).alias("_sst"))
    r2 = F.when(F.col("n_test") > 1, F.when(F.col("_sst") > 0, 1 - F.col("_ssr") / F.col("_sst")).otherwise(F.lit(0.0)))
    return agg.select("series_id", "model", "n_test",
                      py_round("_mae", 2).alias("mae"), py_round("_rmse", 2).alias("rmse"),
                      py_round(F.col("_mape") * 100, 2).alias("mape"), py_round(r2, 4).alias("r2"))


def leaderboard(m: DataFrame, n_points: DataFrame, strict_compat: bool = True) -> DataFrame:
    """composite score and rank per series.

    composite = .4 MAE/1000 + .3 RMSE/1000 + .2 MAPE/100 - .1 max(R², 0).
    With ``strict_compat`` a zero MAPE counts as 50 (as the reference's falsy
    ``or`` does) and the small-sample factor multiplies even a negative score;
    without it a zero MAPE counts as 0 and only positive scores are penalised.
    Models without an MAE get no composite and rank last.
    """
    mape = (F.when(F.col("mape").isNull() | (F.col("mape") == 0), F.lit(50.0)).otherwise(F.col("mape"))
            if strict_compat else F.coalesce(F.col("mape"), F.lit(50.0)))
    c = (F.lit(0.4) * (F.col("mae") / 1000) + F.lit(0.3) * (F.coalesce(F.col("rmse"), F.lit(0.0)) / 1000)
         + F.lit(0.2) * (mape / 100) - F.lit(0.1) * F.greatest(F.coalesce(F.col("r2"), F.lit(0.0)), F.lit(0.0)))
    hungry = F.col("model").isin(DATA_HUNGRY) & (F.col("n") < 24)
    factor = F.lit(1.0) + F.greatest(F.lit(0.0), (F.lit(24) - F.col("n")) / 12.0)
    penalise = hungry if strict_compat else hungry & (c > 0)
    c = F.when(penalise, c * factor).otherwise(c)
    composite = F.when(F.col("mae").isNotNull(), py_round(c, 4))
    order = F.array_position(F.array(*[F.lit(x) for x in MODEL_ORDER]), F.col("model"))
    scored = m.join(n_points, "series_id").withColumn("composite", composite).withColumn("_ord", order)
    w = Window.partitionBy("series_id").orderBy(F.col("composite").asc_nulls_last(), F.col("_ord"))
    return scored.select("series_id", "model", "mae", "rmse", "mape", "r2", "composite",
                         F.row_number().over(w).alias("rank"),
                         ((F.col("r2") < 0) | (F.col("mape") > 50)).alias("underperforming"))


def on_board(m: DataFrame, preds: DataFrame) -> DataFrame:
    """ARIMA enters the leaderboard only where it produced a forecast."""
    forecast = (preds.where((F.col("kind") == "future") & (F.col("model") == "arima")).select("series_id", "model").distinct()
                .withColumn("_has", F.lit(True)))
    return (m.join(forecast, ["series_id", "model"], "left")
            .where((F.col("model") != "arima") | F.col("_has")).drop("_has"))
