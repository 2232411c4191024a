"""Coefficient of variation and the lag-free unit-root test, both per product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.config import KEY, QTY, ForecastConfig
from weekloom.operators.series import product_weeks

# MacKinnon (1994) response surface of the Dickey-Fuller statistic with constant.
# p = Phi(polynomial in the statistic), one polynomial up to DF_SPLIT and one above it.
DF_SMALL = (2.1659, 1.4412, 0.038269)
DF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
DF_SPLIT, DF_MIN, DF_MAX = -1.61, -18.83, 2.74
# Fixed value: standard normal 5 % quantile.
NORMAL_5_PERCENT = -1.6448536269514722


def demand_cov(df: DataFrame, cfg: ForecastConfig, col: str = QTY) -> DataFrame:
    """Sample sigma over mean; ``cov_class`` 'high' from ``cov_cut`` on, 'low' below, null if undefined."""
    cov = F.try_divide(F.stddev_samp(col), F.avg(col))
    return (
        df.groupBy(KEY)
        .agg(cov.alias("cov"))
        .withColumn("cov_class", F.when(F.col("cov") >= cfg.cov_cut, "high").when(F.col("cov") < cfg.cov_cut, "low"))
    )


def dickey_fuller_lag0(df: DataFrame, col: str = QTY) -> DataFrame:
    """Dickey-Fuller test without lagged differences, from regression aggregates.

    dx(t) = a + b x(t-1): ``stat`` is the t value of b, ``z`` the normal quantile of its p value
    (``stationary`` when p is below 5 %), ``d`` the differencing order 0 or 1.
    """
    prev = F.lag(col).over(product_weeks())
    rows = df.select(KEY, prev.alias("x"), (F.col(col) - prev).alias("dx")).where(F.col("x").isNotNull())
    sums = rows.groupBy(KEY).agg(
        F.count("*").alias("n_obs"),
        F.regr_slope("dx", "x").alias("b"),
        F.regr_sxx("dx", "x").alias("sxx"),
        F.regr_syy("dx", "x").alias("syy"),
        F.regr_sxy("dx", "x").alias("sxy"),
    )
    rss = F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    se = F.sqrt(F.try_divide(rss, (F.col("n_obs") - 2) * F.col("sxx")))
    t = F.col("stat")
    poly = lambda c: sum((F.lit(v) * F.pow(t, F.lit(float(i))) for i, v in enumerate(c)), F.lit(0.0))
    z = F.when(t <= DF_SPLIT, poly(DF_SMALL)).otherwise(poly(DF_LARGE))
    stationary = F.when(t < DF_MIN, True).when(t > DF_MAX, False).otherwise(z < NORMAL_5_PERCENT)
    return (
        sums.withColumn("stat", F.try_divide(F.col("b"), se))
        .withColumn("z", z)
        .withColumn("stationary", F.coalesce(stationary, F.lit(False)))
        .select(KEY, "n_obs", "stat", "z", "stationary", F.when(F.col("stationary"), 0).otherwise(1).alias("d"))
    )
