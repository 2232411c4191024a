"""The 50 weeks of a window regressed on the values 1, 2, 3, 4, 12 and 26 weeks after it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.config import DAY, GROUP, KEY, QTY, ForecastConfig
from weekloom.operators.gram import gram, matrix, series_length
from weekloom.operators.scaling import scale
from weekloom.operators.series import series_arrays, week_at
from weekloom.session import join_small, stage


def _windows(cfg: ForecastConfig, weeks: int):
    """Design rows (1, window values, targets) of the train windows of a block of series."""
    reach = max(cfg.steps)
    train = int(cfg.train_share * (weeks - cfg.window - reach + 1))
    width, steps = cfg.window, np.array(cfg.steps)

    def rows(y: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(y, width + reach, axis=1)[:, :train]
        z = np.concatenate([view[..., :width], view[..., width + steps - 1]], axis=2)
        z = z.reshape(-1, z.shape[2])
        return np.hstack([np.ones((len(z), 1)), z])

    return rows


def _solve(cfg: ForecastConfig):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        m = matrix(rows)
        k = cfg.window + 1
        coef = np.linalg.pinv(m[:k, :k], rcond=1e-10, hermitian=True) @ m[:k, k:]
        return pd.DataFrame(
            {
                GROUP: rows[GROUP].iloc[0],
                "step": np.array(cfg.steps, dtype="int32"),
                "intercept": coef[0],
                "weights": list(coef[1:].T),
            }
        )

    return solve


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)


def window_series(history: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Standard scores of each product as an array, with the mean and sigma for the way back."""
    fit = F.col(DAY) < F.lit(cfg.split_date) if cfg.scale_fit_on == "train" else None
    scaled = scale(history.select(KEY, DAY, GROUP, QTY), QTY, KEY, fit)
    return series_arrays(scaled, QTY, GROUP, mu=F.min("mu"), sd=F.min("sd"))


def window_gram(series: DataFrame, weeks: int, cfg: ForecastConfig) -> DataFrame:
    """(sis_group_id, i, j, s), i <= j; columns: 1, the window's weeks, the targets."""
    return gram(series, "y", weeks, {0: _windows(cfg, weeks)}, GROUP).drop("design")


def forecast_window(history: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Forecasts of the last window, by a model per product group (``scope`` 'group') and one over
    all products ('total'). Inputs are standard scores per product; forecasts below zero become zero.
    """
    series = stage(window_series(history, cfg), "window-series")
    weeks = series_length(series, "y", cfg.window + max(cfg.steps) + 1)
    sums = stage(window_gram(series, weeks, cfg), "window-gram")
    schema = f"{GROUP} bigint, step int, intercept double, weights array<double>"
    by_group = sums.groupBy(GROUP).applyInPandas(_solve(cfg), schema)
    overall = (
        sums.groupBy("i", "j").agg(F.sum("s").alias("s")).withColumn(GROUP, F.lit(0).cast("bigint"))
    )
    total = overall.groupBy(GROUP).applyInPandas(_solve(cfg), schema)

    def pack(scope: str) -> Column:
        model = F.struct("step", "intercept", "weights").alias("m")
        return F.collect_list(F.struct(F.lit(scope).alias("scope"), model))

    models = stage(by_group.groupBy(GROUP).agg(pack("group").alias("own")), "window-models")
    last = F.slice("y", F.col("n") - max(cfg.steps) - cfg.window + 1, cfg.window)
    ready = series.withColumns({"x": last, "shared": total.agg(pack("total")).scalar()})
    # Six weight vectors per group, some 3 kB.
    rows = join_small(ready, models, GROUP, max_rows=10_000).select(
        KEY, GROUP, "mu", "sd", "n", "first_week", "y", "x", F.inline(F.concat("own", "shared"))
    )
    level = _dot(F.col("x"), F.col("m.weights")) + F.col("m.intercept")
    actual = F.get("y", F.col("n") - max(cfg.steps) + F.col("m.step") - 1)
    return rows.select(
        F.lit("window").alias("model"),
        "scope",
        KEY,
        GROUP,
        F.col("m.step").alias("step"),
        week_at(F.col("n") - max(cfg.steps) + F.col("m.step") - 1),
        (actual * F.col("sd") + F.col("mu")).alias("y"),
        F.greatest(level * F.col("sd") + F.col("mu"), F.lit(0.0)).alias("yhat"),
    )
