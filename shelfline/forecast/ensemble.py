"""Ensemble band, outlier-model guard and the per-series summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import py_round
from .models import MODEL_ORDER
from .panel import clip


def _future(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("kind") == "future").select("series_id", "model", "step", "yhat")


# Models whose forecasts judge the guarded one.
GUARD_MODELS = ("random_forest", "linear_regression", "lstm", "xgboost")


def guard(preds: DataFrame, info: DataFrame, target: str = "xgboost") -> DataFrame:
    """the candidates are the GUARD_MODELS that a series has, the target excluded.  If any step of ``target`` deviates from the candidates' mean by more than
    2·std(candidates) + 1 % of the series' mean, replace every step of it by
    round(clip(0.6·target + 0.4·mean), 2).  Other rows pass unchanged, also those of a
    series that has no candidates."""
    fut = _future(preds)
    cand = (fut.where(F.col("model").isin([m for m in GUARD_MODELS if m != target])).groupBy("series_id", "step")
            .agg(F.avg("yhat").alias("_cm"), F.stddev_pop("yhat").alias("_cs"),
                 F.count(F.lit(1)).alias("_cn")))
    tgt = (preds.where((F.col("kind") == "future") & (F.col("model") == target))
           .join(cand, ["series_id", "step"], "left").join(info.select("series_id", "ymean", "lo", "hi"), "series_id", "left"))
    dev = F.abs(F.col("yhat") - F.col("_cm")) > F.lit(2.0) * F.col("_cs") + F.lit(0.01) * F.col("ymean")
    s = Window.partitionBy("series_id")
    # a step without candidates neither raises the guard nor is blended: its forecast stays
    tgt = tgt.withColumn("_blend", (F.max(dev.cast("int")).over(s) == 1) & F.col("_cm").isNotNull())
    fixed = tgt.select("series_id", "model", "kind", "step", "actual",
                       F.when(F.col("_blend"), py_round(clip(F.lit(0.6) * F.col("yhat") + F.lit(0.4) * F.col("_cm")), 2))
                       .otherwise(F.col("yhat")).alias("yhat"))
    rest = preds.where(~((F.col("kind") == "future") & (F.col("model") == target)))
    return rest.unionByName(fixed)


def ensemble(preds: DataFrame, horizon: int) -> DataFrame:
    """per (series, step) mean, population std, mean ± 1.96 std over models that
    have exactly ``horizon`` future values; no rows when fewer than 2 such models."""
    fut = _future(preds)
    full = (fut.groupBy("series_id", "model").agg(F.count(F.lit(1)).alias("_c"))
            .where(F.col("_c") == horizon).select("series_id", "model"))
    ok = fut.join(full, ["series_id", "model"])
    agg = ok.groupBy("series_id", "step").agg(F.avg("yhat").alias("_m"), F.stddev_pop("yhat").alias("_s"),
                                              F.count(F.lit(1)).alias("models"))
    return agg.where(F.col("models") >= 2).select(
        "series_id", "step", "models", py_round("_m", 2).alias("ensemble"),
        py_round(F.col("_m") - 1.96 * F.col("_s"), 2).alias("lower"),
        py_round(F.col("_m") + 1.96 * F.col("_s"), 2).alias("upper"),
        py_round("_s", 2).alias("std"))


def residuals(preds: DataFrame) -> DataFrame:
    """actual − fitted for every window of every model with fitted values."""
    return (preds.where(F.col("kind") == "fit")
            .select("series_id", "model", F.col("step").alias("window"),
                    py_round(F.col("actual") - F.col("yhat"), 2).alias("residual")))


def comparison(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """model × month table of future values (one column per model)."""
    fut = _future(preds).join(labels, ["series_id", "step"])
    present = [m for m in MODEL_ORDER]
    return fut.groupBy("series_id", "period").pivot("model", present).agg(F.first("yhat"))


def step_changes(preds: DataFrame, info: DataFrame) -> DataFrame:
    """Change of each future step vs the previous one (the last actual for step 1),
    (v − prev) / |prev| · 100, 0 when prev is 0."""
    fut = _future(preds).join(info.select("series_id", "last_y"), "series_id")
    w = Window.partitionBy("series_id", "model").orderBy("step")
    prev = F.coalesce(F.lag("yhat").over(w), F.col("last_y"))
    return fut.select("series_id", "model", "step", "yhat",
                      F.when(prev != 0, py_round((F.col("yhat") - prev) / F.abs(prev) * 100, 2))
                      .otherwise(F.lit(0.0)).alias("delta_pct"))


def best_model(board: DataFrame, preds: DataFrame, ens: DataFrame, info: DataFrame, horizon: int) -> DataFrame:
    """per series the top-ranked model, its forecast, last and average revenue,
    direction (equal counts as down) and the ensemble's total change vs the last actual."""
    best = board.where(F.col("rank") == 1).select("series_id", F.col("model").alias("best_model"))
    fut = _future(preds)
    best_fc = (fut.join(best, "series_id").where(F.col("model") == F.col("best_model"))
               .groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("step", "yhat"))).alias("_b")))
    ens_last = ens.groupBy("series_id").agg(F.max_by("ensemble", "step").alias("_e"),
                                            F.count(F.lit(1)).alias("_en"))
    return (info.join(best, "series_id", "left").join(best_fc, "series_id", "left").join(ens_last, "series_id", "left")
            .select("series_id", F.coalesce(F.col("best_model"), F.lit("ensemble")).alias("best_model"),
                    F.transform("_b", lambda x: x.getField("yhat")).alias("best_future"),
                    py_round("last_y", 2).alias("last_revenue"), py_round("ymean", 2).alias("avg_revenue"),
                    F.when(F.col("last_y") > F.col("prev_y"), F.lit("upward")).otherwise(F.lit("downward"))
                    .alias("revenue_trend"),
                    F.when(F.col("_en") > 0, py_round((F.col("_e") - F.col("last_y")) / F.col("last_y") * 100, 1))
                    .alias("ensemble_change_pct"),
                    F.lit(horizon).alias("horizon")))
