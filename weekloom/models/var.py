"""Vector autoregression per product group on standardised first differences.

With more products than weeks the regression is under-determined and the minimum-norm solution is
wanted. In its dual form every forecast week is a weighted sum of the observed weeks, and the
weights follow from the week-by-week Gram matrix S[t, u] = sum over products of x[t] x[u] alone.
S has at most (number of weeks)^2 entries per group however many products a group has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.config import DAY, GROUP, KEY, QTY, ForecastConfig
from weekloom.models.window import _dot
from weekloom.operators.gram import gram, matrix, series_length
from weekloom.operators.scaling import scale
from weekloom.operators.series import product_weeks, series_arrays, week_at, whole
from weekloom.session import join_small, stage


def forecast_weights(s: np.ndarray, lags: int, steps: int) -> np.ndarray:
    """(steps x weeks) weights of the observed weeks in the forecast *levels* (running sums)."""
    weeks = len(s)
    t = np.arange(lags, weeks)
    # Inner products of the regressor rows (1, x[t-1], ..., x[t-lags]).
    k = 1.0 + sum(s[np.ix_(t - lag, t - lag)] for lag in range(1, lags + 1))
    inverse = np.linalg.pinv(k, rcond=1e-10, hermitian=True)
    made = np.vstack([np.eye(weeks), np.zeros((steps, weeks))])
    for h in range(weeks, weeks + steps):
        inner = np.ones(len(t))
        for lag in range(1, lags + 1):
            inner += made[h - lag] @ s[:, t - lag]
        made[h, t] = inverse @ inner
    return np.cumsum(made[weeks:], axis=0)


def var_series(history: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Per product: standard scores ``y`` of all weeks and their train differences ``x``."""
    w = product_weeks()
    fit = None
    if cfg.scale_fit_on == "train":
        left = F.count("*").over(whole(w)) - F.row_number().over(w)
        history = history.withColumn("_left", left)
        fit = F.col("_left") >= cfg.var_test
    scaled = scale(history, QTY, KEY, fit)
    series = series_arrays(scaled, QTY, GROUP, mu=F.min("mu"), sd=F.min("sd"))
    train = F.slice("y", F.lit(1), F.greatest(F.col("n") - cfg.var_test, F.lit(0)))
    lead = F.slice(train, F.lit(2), F.greatest(F.size(train) - 1, F.lit(0)))
    diff = F.zip_with(lead, F.slice(train, F.lit(1), F.size(lead)), lambda b, a: b - a)
    return series.withColumn("x", diff)


def var_gram(series: DataFrame, weeks: int) -> DataFrame:
    """(sis_group_id, i, j, s) with i <= j."""
    return gram(series, "x", weeks, {0: lambda x: x}, GROUP).drop("design")


def forecast_var(history: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """``var_test`` steps after the train weeks."""
    series = stage(var_series(history.select(KEY, DAY, GROUP, QTY), cfg), "var-series")
    weeks = series_length(series, "x", cfg.var_lags + 1)
    sums = stage(var_gram(series, weeks), "var-gram")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        weights = forecast_weights(matrix(rows), cfg.var_lags, cfg.var_test)
        return pd.DataFrame({GROUP: [rows[GROUP].iloc[0]], "weights": [weights.tolist()]})

    weights = sums.groupBy(GROUP).applyInPandas(solve, f"{GROUP} bigint, weights array<array<double>>")
    models = stage(weights, "var-weights")
    # A row of weights is var_test x weeks numbers, some 30 kB: broadcast only a few thousand.
    rows = join_small(series, models, GROUP, max_rows=2_000).select(
        KEY, GROUP, "mu", "sd", "n", "first_week", "y", "x", F.posexplode("weights").alias("p", "w")
    )
    base = F.get("y", F.col("n") - cfg.var_test - 1)
    actual = F.get("y", F.col("n") - cfg.var_test + F.col("p"))
    return rows.select(
        F.lit("var").alias("model"),
        KEY,
        GROUP,
        (F.col("p") + 1).alias("step"),
        week_at(F.col("n") - cfg.var_test + F.col("p")),
        (actual * F.col("sd") + F.col("mu")).alias("y"),
        ((base + _dot(F.col("x"), F.col("w"))) * F.col("sd") + F.col("mu")).alias("yhat"),
    )
