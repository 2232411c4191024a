"""Products by number of sales weeks: high and low rotation, rare products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.config import FLAG, KEY, ForecastConfig
from weekloom.operators.series import product_weeks, whole


def rotation_flag(df: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Flag products with more than ``high_rotation_weeks`` weeks.

    (product, week) must be unique, so the row count is the number of distinct weeks.
    """
    weeks = F.count("*").over(whole(product_weeks()))
    return df.withColumn(FLAG, weeks > cfg.high_rotation_weeks)


def drop_rare_products(df: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Keep products with more than ``min_rotation`` rows."""
    rows = F.count("*").over(whole(product_weeks()))
    return df.withColumn("_rows", rows).where(F.col("_rows") > cfg.min_rotation).drop("_rows")


def rotation_summary(flagged: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Number of high, low and all products, and how many are too rare to keep."""
    per_product = flagged.groupBy(KEY).agg(
        F.bool_or(FLAG).alias("high"), F.count("*").alias("n_rows")
    )
    return per_product.agg(
        F.count("*").alias("products"),
        F.count_if("high").alias("high_products"),
        F.count_if(~F.col("high")).alias("low_products"),
        F.count_if(F.col("n_rows") <= cfg.min_rotation).alias("rare_products"),
    )
