"""Filler rows between the present rows of a product.

No grid join: each row knows its next row, so the weeks in between are exploded from the row
itself. The shuffle and sort are the ones the product window already has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.config import COUNTER, DAY, KEY, MEASURES
from weekloom.functions.weeks import calendar_year, iso_week
from weekloom.operators.series import product_weeks, whole


def fill_weeks(
    df: DataFrame, before: Column, after: Column, neighbours: Column, steady: tuple[str, ...] = ()
) -> DataFrame:
    """All rows of ``df`` plus filler rows.

    ``after`` holds the weeks to add between a row and the product's next row (or after its last
    one), ``before`` those ahead of its first row. Where ``neighbours`` is true a filler is the mean
    of the rows around it, or a copy when only one side exists; the averaged weekly number is
    rounded half to even. Elsewhere a filler is zero, with the remaining columns of the newest row
    (``steady`` ones do not vary within a product). Week number and year of a filler are the ISO week
    and the calendar year of its day. Columns named with a leading underscore are dropped.
    """
    cols = [c for c in df.columns if not c.startswith("_")]
    values = [*MEASURES, COUNTER]
    derived = [KEY, DAY, "sales_week", "sales_year", *values]
    varying = [c for c in cols if c not in derived and c not in steady]
    w = product_weeks()
    ahead = {
        "_next": F.lead(F.struct(*values)).over(w),
        "_first": F.row_number().over(w) == 1,
        "_use": neighbours,
    }
    if varying:
        ahead["_newest"] = F.last(F.struct(*varying)).over(whole(w))
    days = F.concat(
        F.array(DAY), after, F.when(F.col("_first"), before).otherwise(F.array().cast("array<date>"))
    )
    # The key is passed through untouched, so the product partitioning survives the explosion.
    rows = df.withColumns(ahead).withColumn("_day", F.explode(days))

    day, own, use = F.col("_day"), F.col("_day") == F.col(DAY), F.col("_use")
    between = (day > F.col(DAY)) & F.col("_next").isNotNull()

    def blank(name: str) -> Column:
        return F.lit(0).cast(df.schema[name].dataType)

    def cell(name: str) -> Column:
        col = F.col(name)
        if name == KEY:
            return col
        if name == DAY:
            return day
        if name == "sales_week":
            return F.when(own, col).otherwise(iso_week(day))
        if name == "sales_year":
            return F.when(own, col).otherwise(calendar_year(day))
        if name in values:
            mean = (col + F.col("_next")[name]) / 2
            if name == COUNTER:
                mean = F.bround(mean, 0).cast("bigint")
            return F.when(own | (use & ~between), col).when(use, mean).otherwise(blank(name))
        return F.when(own | use, col).otherwise(F.col("_newest")[name]) if name in varying else col

    return rows.select(*[cell(c).alias(c) for c in cols])
