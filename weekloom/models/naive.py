"""Next weeks equal this week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.config import DAY, GROUP, KEY, QTY, ForecastConfig
from weekloom.operators.metrics import trim_last_steps
from weekloom.operators.series import weeks_after


def forecast_naive(history: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """From every week of the validation part, for each step that still has an actual value."""
    valid = history.where(F.col(DAY) >= F.lit(cfg.split_date))
    return trim_last_steps(valid, cfg.steps).select(
        F.lit("naive").alias("model"),
        KEY,
        GROUP,
        DAY,
        "step",
        weeks_after(F.col("step")),
        "y",
        F.col(QTY).alias("yhat"),
    )
