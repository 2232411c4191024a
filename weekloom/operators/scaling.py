"""Standard scores and mean imputation.

Statistics per group come from an aggregation (partial sums on the map side) and a join, never
from a window over the group, so a group with a large share of all rows is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.config import KEY
from weekloom.operators.series import product_weeks, whole
from weekloom.session import join_small, stage


def _sigma(sd: Column) -> Column:
    """A constant column divides by one."""
    return F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def scale_stats(df: DataFrame, col: str, by: str, fit: Column | None = None) -> DataFrame:
    """Mean and population sigma per ``by``, over the rows where ``fit`` holds (default all)."""
    value = F.col(col) if fit is None else F.when(fit, F.col(col))
    return df.groupBy(by).agg(F.avg(value).alias("mu"), _sigma(F.stddev_pop(value)).alias("sd"))


def scale(df: DataFrame, col: str, by: str | None, fit: Column | None = None) -> DataFrame:
    """Replace ``col`` by its standard score; adds ``mu`` and ``sd`` for the way back.

    ``by`` is the product (window over its few rows), a group column, or None for all rows.
    """
    value = F.col(col) if fit is None else F.when(fit, F.col(col))
    if by == KEY:
        w = whole(product_weeks())
        stats = df.withColumns({"mu": F.avg(value).over(w), "sd": _sigma(F.stddev_pop(value).over(w))})
    elif by is None:
        one = df.agg(F.struct(F.avg(value).alias("mu"), _sigma(F.stddev_pop(value)).alias("sd"))).scalar()
        stats = df.withColumns({"mu": one["mu"], "sd": one["sd"]})
    else:
        stats = join_small(df, stage(scale_stats(df, col, by, fit), "scale"), by)
    return stats.withColumn(col, (F.col(col) - F.col("mu")) / F.col("sd"))


def unscale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Undo ``scale`` with the ``mu`` and ``sd`` the rows carry."""
    return df.withColumns({c: F.col(c) * F.col("sd") + F.col("mu") for c in cols}).drop("mu", "sd")


def impute_mean(df: DataFrame, cols: list[str], fit: Column) -> DataFrame:
    """Null becomes the mean of the column over the rows where ``fit`` holds."""
    means = df.where(fit).agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), means[c]) for c in cols})
