"""Two rows of one product in one week (weeks cut by New Year): find and merge them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.config import COUNTER, DAY, DISCOUNT, KEY, PRICE, QTY


def duplicate_weeks(df: DataFrame) -> DataFrame:
    """(product, week) keys that occur more than once, with their row count."""
    return df.groupBy(KEY, DAY).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def merge_duplicate_weeks(df: DataFrame) -> DataFrame:
    """One row per (product, week): summed quantity, discount and weekly number, mean price;
    the other columns come from the row with the smallest (sales_year, sales_week).

    Every aggregate combines on the map side, so a product with very many rows sends at most one
    row per week and map task through the shuffle. The minimum of the whole struct makes "first"
    deterministic even if a (year, week) pair repeats.
    """
    rest = [c for c in df.columns if c not in (KEY, DAY, QTY, PRICE, DISCOUNT, COUNTER)]
    order = ["sales_year", "sales_week"]
    first = F.struct(*order, *[c for c in rest if c not in order])
    merged = df.groupBy(KEY, DAY).agg(
        F.sum(QTY).alias(QTY),
        F.avg(PRICE).alias(PRICE),
        F.sum(DISCOUNT).alias(DISCOUNT),
        F.sum(COUNTER).alias(COUNTER),
        F.min(first).alias("first_row"),
    )
    return merged.select(
        *[F.col(f"first_row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns]
    )
