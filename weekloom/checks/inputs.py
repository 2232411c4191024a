"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.config import MEASURES, PRICE, ForecastConfig
from weekloom.functions.weeks import week_first_day
from weekloom.operators.complete import complete
from weekloom.operators.outliers import replace_outliers, upper_limits
from weekloom.plans.preparation import prepare
from weekloom.session import stage
from weekloom.sources.lineitem import raw_demand

# The data ends in 2001, so the split date of the defaults moves; all else stays.
CFG = ForecastConfig(split_date=dt.date(2000, 10, 30))

# Weeks taken out for all products to exercise calendar repair.
INTERIOR_GAP = ("2000-03-06", "2000-03-13", "2001-01-15")
EDGE_GAP = ("1995-01-09",)


def once(build):
    """Stage a shared input once per application and data folder."""
    made: dict[tuple[str, str], DataFrame] = {}

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        where = (spark.sparkContext.applicationId, sf_dir)
        if where not in made:
            made[where] = build(spark, sf_dir)
        return made[where]

    return get


raw = raw_demand


@once
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(prepare(raw(spark, sf_dir), CFG), "prepared")


@once
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = prepared(spark, sf_dir)
    return stage(replace_outliers(complete(base), upper_limits(base, CFG)).drop("all_outliers"), "filtered")


def raw_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    hole = (F.col("product_id") + F.col("sales_week")) % 97 == 0
    return raw(spark, sf_dir).withColumn(PRICE, F.when(~hole, F.col(PRICE)))


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in MEASURES})


def raw_without_weeks(spark: SparkSession, sf_dir: str, weeks: tuple[str, ...]) -> DataFrame:
    day = week_first_day(F.col("sales_week"), F.col("sales_year"))
    return raw(spark, sf_dir).where(~day.cast("string").isin(*weeks))


def tidy(df: DataFrame, single: tuple[str, ...] = (PRICE,)) -> DataFrame:
    """Comparable output: days as text, doubles to six decimals. ``single`` columns go to single
    precision instead: unit prices have decimal ties that two engines may round apart. Adding zero
    turns -0.0 into 0.0."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DoubleType):
            c = (c.cast("float").cast("double") if f.name in single else F.round(c, 6)) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(out)

