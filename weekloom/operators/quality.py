"""Null audit, null removal and measure casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.config import COUNTER, DAY, KEY, MEASURES
from weekloom.functions.weeks import week_first_day


def _missing(df: DataFrame, col: str) -> Column:
    """Null, or NaN in a floating-point column."""
    c = F.col(col)
    return c.isNull() | F.isnan(c) if df.schema[col].dataType.typeName() in ("double", "float") else c.isNull()


def null_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null rows per column, and the percentage of products that have a row in which *all*
    columns with any null are null (0 when no column has nulls).

    One scan: each row carries a bit mask of its null columns. The OR of all masks is the set
    of null columns; a row equal to it is the numerically largest mask, so the maximum per
    product and a second, tiny aggregation over at most 2^columns masks are enough.
    """
    mask = reduce(
        lambda a, b: a + b,
        [F.when(_missing(df, c), F.lit(1 << i)).otherwise(0).cast("bigint") for i, c in enumerate(cols)],
    )
    nulls = [F.count_if(_missing(df, c)).alias(f"n_{i}") for i, c in enumerate(cols)]
    per_product = df.groupBy(KEY).agg(
        F.max(mask).alias("widest"), F.bit_or(mask).alias("any_null"), *nulls
    )
    per_mask = per_product.groupBy("widest").agg(
        F.count("*").alias("products"),
        F.bit_or("any_null").alias("any_null"),
        *[F.sum(f"n_{i}").alias(f"n_{i}") for i in range(len(cols))],
    )
    total = per_mask.agg(
        F.sum("products").alias("products"),
        F.max_by("products", "widest").alias("at_widest"),
        F.max("widest").alias("widest"),
        F.bit_or("any_null").alias("any_null"),
        *[F.sum(f"n_{i}").alias(f"n_{i}") for i in range(len(cols))],
    )
    hit = F.when(
        (F.col("any_null") != 0) & (F.col("widest") == F.col("any_null")), F.col("at_widest")
    ).otherwise(0)
    pct = F.try_divide(hit * 100.0, F.col("products"))
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("null_rows"))
        for i, c in enumerate(cols)
    ]
    return total.select(F.inline(F.array(*rows)), pct.alias("pct_products_all_null"))


def drop_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without a null in any of the columns.

    Stated column by column, so that the scan gets the filters and columns a table declares NOT
    NULL need not be read for it.
    """
    return df.where(reduce(lambda a, b: a & b, [~_missing(df, c) for c in cols]))


def cast_measures(df: DataFrame, on_bad: str = "raise") -> DataFrame:
    """Measures to double. Text that is not a number raises, or becomes null (``on_bad="null"``)."""
    if on_bad not in ("raise", "null"):
        raise ValueError(f"on_bad must be 'raise' or 'null', not {on_bad!r}")
    cast = "cast" if on_bad == "raise" else "try_cast"
    return df.withColumns(
        {c: getattr(F.col(c), cast)("double") for c in MEASURES}
        | {COUNTER: getattr(F.col(COUNTER), cast)("bigint")}
    )


def cast_rejects(df: DataFrame) -> DataFrame:
    """Per measure, how many non-null values are not numbers."""
    return df.agg(
        *[
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c)
            for c in MEASURES
        ]
    )


def with_first_day(df: DataFrame) -> DataFrame:
    """Add the Monday of the sales week."""
    return df.withColumn(DAY, week_first_day(F.col("sales_week"), F.col("sales_year")))
