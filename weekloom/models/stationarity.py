"""Augmented Dickey-Fuller test with constant, lag order by AIC, for all products."""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from weekloom.config import KEY, QTY, ForecastConfig
from weekloom.operators.series import series_arrays
from weekloom.operators.variation import DF_LARGE, DF_MAX, DF_MIN, DF_SMALL, DF_SPLIT

BLOCK = 512  # series handled at once inside a task
SHORTEST = 8  # values that the test needs

ADF_TYPE = T.StructType(
    [
        T.StructField("stat", T.DoubleType()),
        T.StructField("pvalue", T.DoubleType()),
        T.StructField("n_lags", T.IntegerType()),
        T.StructField("n_obs", T.IntegerType()),
    ]
)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * erfc(-v / sqrt(2.0)) for v in z])


def p_value(stat: np.ndarray) -> np.ndarray:
    z = np.where(
        stat <= DF_SPLIT, np.polyval(DF_SMALL[::-1], stat), np.polyval(DF_LARGE[::-1], stat)
    )
    p = _normal_cdf(z)
    return np.where(stat > DF_MAX, 1.0, np.where(stat < DF_MIN, 0.0, p))


def _regressors(x: np.ndarray, lags: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Differences to explain, and [constant, level, lagged differences...] for a block of series."""
    n = x.shape[1]
    dx = np.diff(x, axis=1)
    level = x[:, lags : n - 1]
    lagged = [dx[:, lags - k : n - 1 - k] for k in range(1, lags + 1)]
    return dx[:, lags:], [np.ones_like(level), level, *lagged]


def adf_block(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Test statistic and used lags of each row of ``x``; NaN for constant rows.

    One QR per series serves all lag orders: the residual of the first k columns follows from the
    first k projections.
    """
    n = x.shape[1]
    most = min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    target, cols = _regressors(x, most)
    q, _ = np.linalg.qr(np.stack(cols, axis=2))
    proj = np.einsum("bnk,bn->bk", q, target)
    rss = (target**2).sum(axis=1, keepdims=True) - np.cumsum(proj**2, axis=1)
    nobs = target.shape[1]
    with np.errstate(all="ignore"):
        aic = nobs * np.log(np.maximum(rss[:, 1:], 1e-300) / nobs) + 2 * np.arange(2, most + 3)
    used = aic.argmin(axis=1)
    stat = np.full(len(x), np.nan)
    for lag in np.unique(used):
        rows = np.flatnonzero(used == lag)
        target, cols = _regressors(x[rows], int(lag))
        cols.append(cols.pop(1))  # level last: its t value is then read off the last projection
        q, r = np.linalg.qr(np.stack(cols, axis=2))
        proj = np.einsum("bnk,bn->bk", q, target)
        rss = np.maximum((target**2).sum(axis=1) - (proj**2).sum(axis=1), 0.0)
        sigma = np.sqrt(rss / (target.shape[1] - len(cols)))
        with np.errstate(all="ignore"):
            stat[rows] = proj[:, -1] * np.sign(r[:, -1, -1]) / sigma
    stat[(x.max(axis=1) == x.min(axis=1)) | ~np.isfinite(stat)] = np.nan
    return stat, used


@pandas_udf(ADF_TYPE)
def _adf(series: pd.Series) -> pd.DataFrame:
    size = series.map(len).to_numpy()
    stat = np.full(len(series), np.nan)
    lags = np.zeros(len(series), dtype=int)
    for n in np.unique(size[size >= SHORTEST]):
        rows = np.flatnonzero(size == n)
        for lo in range(0, len(rows), BLOCK):
            part = rows[lo : lo + BLOCK]
            stat[part], lags[part] = adf_block(np.stack(series.iloc[part].to_list()))
    tested = size >= SHORTEST
    return pd.DataFrame(
        {
            "stat": stat,
            "pvalue": p_value(stat),
            "n_lags": pd.Series(lags, dtype="Int32").where(tested),
            "n_obs": size - 1 - lags,
        }
    )


def adf_column(series: Column) -> Column:
    """Struct (stat, pvalue, n_lags, n_obs) of an array column.

    Statistic and p value of a constant series are null; a series of fewer than SHORTEST values has no lags either.
    """
    return _adf(series)


def difference_order(test: Column, cfg: ForecastConfig) -> Column:
    """0 where the test rejects a unit root, else 1; null for a series too short to test."""
    return F.when(test["n_lags"].isNotNull(), F.when(test["pvalue"] < cfg.adf_level, 0).otherwise(1))


def adf_test(df: DataFrame, cfg: ForecastConfig, col: str = QTY) -> DataFrame:
    """(product_id, stat, pvalue, n_lags, n_obs, d)."""
    tested = series_arrays(df, col).select(KEY, adf_column(F.col("y")).alias("t"))
    return tested.select(KEY, "t.*", difference_order(F.col("t"), cfg).alias("d"))


def non_stationary_count(df: DataFrame, cfg: ForecastConfig, col: str = QTY) -> DataFrame:
    """How many series the test does not reject, the p value rounded to four places."""
    return adf_test(df, cfg, col).agg(
        F.count("*").alias("series"),
        F.count_if(F.round("pvalue", 4) > cfg.adf_level).alias("non_stationary"),
    )
