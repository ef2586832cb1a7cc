"""End-to-end panel forecast: series -> lag table -> per-model predictions ->
metrics -> leaderboard -> guard -> ensemble -> summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import ensemble as en
from . import models as md
from . import scoring as sc
from .boosting import Settings
from .panel import clamp_horizon, future_labels, prepare, rejects, series_info

DEFAULT_MODELS = ("linear_regression", "moving_average", "random_forest", "decision_tree", "xgboost", "arima")


@dataclass
class Forecast:
    panel: DataFrame
    info: DataFrame
    rejects: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    leaderboard: DataFrame
    ensemble: DataFrame
    labels: DataFrame
    horizon: int

    def best(self) -> DataFrame:
        return en.best_model(self.leaderboard, self.predictions, self.ensemble, self.info, self.horizon)

    def comparison(self) -> DataFrame:
        return en.comparison(self.predictions, self.labels)

    def residuals(self) -> DataFrame:
        return en.residuals(self.predictions)

    def step_changes(self) -> DataFrame:
        return en.step_changes(self.predictions, self.info)

    def future(self) -> DataFrame:
        fut = self.predictions.where("kind = 'future'").join(self.labels, ["series_id", "step"])
        return fut.select("series_id", "model", "step", "period", "yhat")


def run_forecast(series: DataFrame, horizon=3, models=DEFAULT_MODELS, guard_target: str | None = "auto",
                 strict_compat: bool = True, extra_predictions: DataFrame | None = None, boost: Settings | None = None) -> Forecast:
    """``series``: (series_id, period DATE, y DOUBLE).  ``extra_predictions`` lets
    externally trained models (same long schema) enter scoring and the ensemble; ``boost`` asks for second-order boosting.  The guard (F21) watches the
    transformer where extra predictions bring one, else the boosted trees."""
    h = clamp_horizon(horizon)
    panel = prepare(series)
    info = series_info(panel)
    parts = []
    if "linear_regression" in models:
        parts.append(md.ridge(panel, info, h))
    if "moving_average" in models:
        parts.append(md.moving_average(panel, info, h))
    trees = tuple(m for m in ("random_forest", "decision_tree", "xgboost") if m in models)
    if trees:
        parts.append(md.tree_models(panel, info, h, trees, boost=boost))
    if "arima" in models:
        parts.append(md.arima(panel, h))
    if extra_predictions is not None:
        parts.append(extra_predictions)
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    targets = ["transformer", "xgboost"] if guard_target == "auto" else [guard_target] if guard_target else []
    for target in targets:
        if target in models or extra_predictions is not None and target == "transformer":
            preds = en.guard(preds, info, target)
            break
    m = sc.metrics(preds)
    board = sc.leaderboard(sc.on_board(m, preds), info.select("series_id", "n"), strict_compat)
    return Forecast(panel=panel, info=info, rejects=rejects(series), predictions=preds, metrics=m,
                    leaderboard=board, ensemble=en.ensemble(preds, h), labels=future_labels(info, h), horizon=h)
