"""Outliers above mean + k sigma of the table before filling, replaced by their neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.config import MEASURES, ForecastConfig
from weekloom.operators.series import next_known, previous_known, product_weeks


def _limits(col: str, sigma: float) -> list[Column]:
    """Population sigma, as the limits are of the whole table."""
    mean, sd = F.avg(col), F.stddev_pop(col)
    return [
        mean.alias("mean"),
        sd.alias("sd"),
        (mean - sigma * sd).alias("lower"),
        (mean + sigma * sd).alias("upper"),
    ]


def outlier_limits(prepared: DataFrame, cfg: ForecastConfig, cols: tuple[str, ...] = MEASURES) -> DataFrame:
    """Mean, sigma, lower and upper limit per measure, from one scan. Only the upper one is used."""
    one = prepared.agg(*[F.struct(*_limits(c, cfg.sigma)).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"{c}.*")) for c in cols])
    return one.select(F.inline(rows))


def upper_limits(prepared: DataFrame, cfg: ForecastConfig, cols: tuple[str, ...] = MEASURES) -> Column:
    """Scalar struct with the upper limit of each measure."""
    return prepared.agg(
        F.struct(*[(F.avg(c) + cfg.sigma * F.stddev_pop(c)).alias(c) for c in cols])
    ).scalar()


def outlier_rows(df: DataFrame, col: str, prepared: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Rows at or above the upper limit."""
    return df.where(F.col(col) >= upper_limits(prepared, cfg, (col,))[col])


def replace_outliers(df: DataFrame, limits: Column, cols: tuple[str, ...] = MEASURES) -> DataFrame:
    """Replace values at or above their limit by the mean of the nearest earlier and later normal
    value of the product; at the ends the one that exists is copied.

    A product without any normal value keeps its values and is marked in ``all_outliers``. The
    measures do not look at each other, so one window pass serves all of them.
    """
    w = product_weeks()
    normal = df.withColumns({f"_{c}": F.when(F.col(c) < limits[c], F.col(c)) for c in cols})
    around = normal.withColumns(
        {f"_{c}_prev": previous_known(f"_{c}").over(w) for c in cols}
        | {f"_{c}_next": next_known(f"_{c}").over(w) for c in cols}
    )
    values, stuck = {}, []
    for c in cols:
        prev, nxt = F.col(f"_{c}_prev"), F.col(f"_{c}_next")
        mean = (F.coalesce(prev, nxt) + F.coalesce(nxt, prev)) / 2
        values[c] = F.coalesce(F.col(f"_{c}"), mean, F.col(c))
        stuck.append(F.col(f"_{c}").isNull() & mean.isNull())
    flagged = around.withColumns(values | {"all_outliers": reduce(lambda a, b: a | b, stuck)})
    return flagged.select(*df.columns, "all_outliers")
