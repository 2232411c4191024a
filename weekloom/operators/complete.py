"""Every kept product gets a row in every week of the kept range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekloom.config import ATTRIBUTES, COUNTER, DAY, FLAG, KEY, MEASURES
from weekloom.functions.weeks import calendar_year, iso_week, weeks_between
from weekloom.operators.fill import fill_weeks
from weekloom.operators.series import product_weeks, whole

WEEK_COLUMNS = [KEY, "sales_week", "sales_year", *MEASURES, DAY, FLAG, COUNTER]


def _span(prepared: DataFrame) -> Column:
    return prepared.agg(F.struct(F.min(DAY).alias("first"), F.max(DAY).alias("last"))).scalar()


def week_product_grid(prepared: DataFrame) -> DataFrame:
    """Distinct weeks times distinct low-rotation products.

    The weeks (at most ``keep_weeks`` days) travel as one scalar array and are exploded per
    product, so there is no join.
    """
    weeks = prepared.select(DAY).distinct().agg(F.array_sort(F.collect_set(DAY))).scalar()
    low = prepared.where(~F.col(FLAG)).select(KEY).distinct()
    return low.select(F.explode(weeks).alias(DAY), KEY)


def _fill(rows: DataFrame, span: Column) -> DataFrame:
    w = product_weeks()
    ready = rows.withColumns(
        {"_from": span["first"], "_to": span["last"], "_next_day": F.lead(DAY).over(w)}
    )
    until = F.coalesce(F.date_sub(F.col("_next_day"), 7), F.col("_to"))
    after = weeks_between(F.date_add(F.col(DAY), 7), until)
    before = weeks_between(F.col("_from"), F.date_sub(F.col(DAY), 7))
    steady = tuple(c for c in rows.columns if c in (FLAG, "newest"))
    return fill_weeks(ready, before, after, F.col(FLAG), steady)


def _low_week_parts(df: DataFrame) -> DataFrame:
    """ISO week and calendar year on all rows of low-rotation products, real ones included."""
    day = F.col(DAY)
    return df.withColumns(
        {
            "sales_week": F.when(F.col(FLAG), F.col("sales_week")).otherwise(iso_week(day)),
            "sales_year": F.when(F.col(FLAG), F.col("sales_year")).otherwise(calendar_year(day)),
        }
    )


def fill_high_rotation(prepared: DataFrame) -> DataFrame:
    """High-rotation products on all weeks: neighbour means in the holes."""
    rows = prepared.where(F.col(FLAG)).select(WEEK_COLUMNS)
    return _fill(rows, _span(prepared))


def fill_low_rotation(prepared: DataFrame) -> DataFrame:
    """Low-rotation products on all weeks: zeros in the holes."""
    rows = prepared.where(~F.col(FLAG)).select(WEEK_COLUMNS)
    return _low_week_parts(_fill(rows, _span(prepared)))


def rank_real_over_filler(prepared: DataFrame) -> DataFrame:
    """The same low-rotation table the ranking way: real rows and a zero grid are stacked, and the
    real row of a (week, product) outranks the filler by its table name."""
    grid = week_product_grid(prepared).withColumns(
        {
            **{c: F.lit(0.0) for c in MEASURES},
            "Table_name": F.lit("DATA_C"),
            COUNTER: F.lit(0).cast("bigint"),
        }
    )
    real = prepared.where(~F.col(FLAG)).select(
        DAY, KEY, *MEASURES, F.lit("DATA_NC").alias("Table_name"), COUNTER
    )
    w = Window.partitionBy(KEY, DAY).orderBy(F.desc("Table_name"))
    return (
        grid.unionByName(real)
        .withColumn("ranking", F.rank().over(w))
        .where("ranking = 1")
        .drop("ranking")
    )


def union_completed(low: DataFrame, high: DataFrame) -> DataFrame:
    """Stack both halves; a column only one side has becomes null on the other."""
    return low.unionByName(high, allowMissingColumns=True)


def product_attributes(prepared: DataFrame) -> DataFrame:
    """One row per product: the attributes of its newest week."""
    newest = F.max_by(F.struct(*ATTRIBUTES), F.col(DAY)).alias("a")
    return prepared.groupBy(KEY).agg(newest).select(KEY, "a.*")


def attach_attributes(df: DataFrame, prepared: DataFrame) -> DataFrame:
    """Left join of the product attributes onto completed rows."""
    return df.join(product_attributes(prepared), KEY, "left")


def complete(prepared: DataFrame) -> DataFrame:
    """Both fills and the attributes in one pass over the product windows (no join)."""
    w = product_weeks()
    newest = F.last(F.struct(*ATTRIBUTES)).over(whole(w))
    rows = prepared.withColumn("newest", newest).select(*WEEK_COLUMNS, "newest")
    filled = _low_week_parts(_fill(rows, _span(prepared)))
    return filled.select(*WEEK_COLUMNS, "newest.*")


def grid_completeness(df: DataFrame, prepared: DataFrame) -> DataFrame:
    """Per rotation class: rows, products, weeks, and whether rows = products x weeks."""
    weeks = prepared.agg(F.count_distinct(DAY)).scalar()
    return (
        df.groupBy(KEY, FLAG)
        .agg(F.count("*").alias("n_rows"))
        .groupBy(FLAG)
        .agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("products"))
        .withColumn("weeks", weeks)
        .withColumn("is_complete", F.col("n_rows") == F.col("products") * F.col("weeks"))
    )
