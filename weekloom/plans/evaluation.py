"""All forecasters on the filtered table, their score tables, and the comparison."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.config import GROUP, KEY, ForecastConfig
from weekloom.models.arima import forecast_arima
from weekloom.models.forest import forecast_forest
from weekloom.models.naive import forecast_naive
from weekloom.models.ridge import forecast_ridge
from weekloom.models.var import forecast_var
from weekloom.models.window import forecast_window
from weekloom.operators.metrics import leaderboard, scores_by_group_and_total, shared_targets, step_group_table
from weekloom.session import stage
from weekloom.sources.tables import scan_filtered, write_table

FORECASTERS = {
    "naive": forecast_naive,
    "arima": forecast_arima,
    "ridge": forecast_ridge,
    "forest": forecast_forest,
    "var": forecast_var,
    "window": forecast_window,
}

#: Models whose default split starts from another week than the rest.
OWN_SPLIT = {"arima", "var"}


def steps_of(model: str, cfg: ForecastConfig) -> tuple[int, ...]:
    return cfg.arima_steps if model.startswith("arima") else cfg.steps


def compare(forecasts: list[DataFrame], cfg: ForecastConfig) -> DataFrame:
    """Scores of all models, each over all it has forecast, ranked per group (and in total) and step by RMSE.

    All long forecasts are scored in one aggregation.
    """
    return leaderboard(scores_by_group_and_total(_stacked(forecasts), _steps(cfg)))


def compare_shared(forecasts: list[DataFrame], cfg: ForecastConfig) -> DataFrame:
    """Like ``compare``, but over the (product, target week, step) that every model, one in each frame, has forecast.

    Models that start from different weeks share none; forecast with ``shared_origin(cfg)``.
    """
    return leaderboard(scores_by_group_and_total(shared_targets(_stacked(forecasts), len(forecasts)), _steps(cfg)))


def shared_origin(cfg: ForecastConfig) -> ForecastConfig:
    """The same newest weeks held out by every model, as many as the largest step."""
    held = max(cfg.steps)
    return replace(cfg, arima_test=held, arima_horizon=held, arima_steps=cfg.steps, var_test=held, ridge_test=held)


def _steps(cfg: ForecastConfig) -> tuple[int, ...]:
    return tuple(sorted({*cfg.steps, *cfg.arima_steps}))


def _stacked(forecasts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_scoped(f) for f in forecasts])


def _scoped(forecast: DataFrame) -> DataFrame:
    rows = forecast if "scope" in forecast.columns else forecast.withColumn("scope", F.lit("both"))
    return rows.select("model", "scope", KEY, GROUP, "step", "target_week", "y", "yhat")


def save_scores(forecast: DataFrame, model: str, cfg: ForecastConfig) -> None:
    """The ``RMSE_*`` and ``WMAPE_*`` tables: one row per step, one column per group and total."""
    scores = stage(scores_by_group_and_total(forecast, steps_of(model, cfg)), f"scores-{model}")
    for metric in ("rmse", "wmape"):
        write_table(step_group_table(scores, metric), cfg.score_table(metric.upper(), model))


def evaluate(spark: SparkSession, cfg: ForecastConfig, models: tuple[str, ...] = tuple(FORECASTERS)) -> DataFrame:
    """Read the filtered table, run the forecasters, save their scores, return the leaderboard.

    The score tables follow each model's own split; the ranking is over shared targets, for which the
    models with another split forecast once more.
    """
    history = scan_filtered(spark, cfg)
    made = {m: stage(FORECASTERS[m](history, cfg), f"forecast-{m}") for m in models}
    for model, rows in made.items():
        save_scores(rows, model, cfg)
    fair = shared_origin(cfg)
    for model in OWN_SPLIT & made.keys():
        made[model] = stage(FORECASTERS[model](history, fair), f"forecast-{model}")
    return compare_shared(list(made.values()), fair)
