"""Shared building blocks over one product's weekly series.

Once duplicate weeks are merged, a product has at most one row per calendar week, so every window
below sorts a bounded number of rows, however many products or raw rows there are. All windows
partition by product (a second key only refines that), so a chain of them needs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from weekloom.config import DAY, KEY


def product_weeks(*within: str) -> WindowSpec:
    return Window.partitionBy(KEY, *within).orderBy(DAY)


def whole(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def next_known(col: str) -> Column:
    """Nearest later non-null value (use with ``over``); streams, unlike a following frame."""
    return F.expr(f"lead(`{col}`) ignore nulls")


def previous_known(col: str) -> Column:
    return F.expr(f"lag(`{col}`) ignore nulls")


def series_arrays(
    df: DataFrame, value: str, *extra: str, also: tuple[str, ...] = (), **aggregates: Column
) -> DataFrame:
    """One row per product: number of weeks, first and last week, values ``y`` in week order.

    ``extra`` columns are attributes that are kept (smallest value if they vary); columns named in
    ``also`` become arrays like ``y``; ``aggregates`` are computed over the product's rows.
    """
    values = [F.col(c).cast("double").alias(c) for c in also]
    cells = F.array_sort(F.collect_list(F.struct(DAY, F.col(value).cast("double").alias("y"), *values)))
    made = [F.min(c).alias(c) for c in extra] + [c.alias(n) for n, c in aggregates.items()]
    grouped = df.groupBy(KEY).agg(cells.alias("cells"), *made)
    return grouped.select(
        KEY,
        *extra,
        *aggregates,
        F.size("cells").alias("n"),
        F.col("cells")[0][DAY].alias("first_week"),
        F.element_at("cells", -1)[DAY].alias("last_week"),
        F.col("cells.y").alias("y"),
        *[F.col(f"cells.{c}").alias(c) for c in also],
    )


def week_at(position: Column) -> Column:
    """``target_week``: the week at a position (from 0) of a series without gaps, or after its end."""
    return F.date_add("first_week", (7 * position).cast("int")).alias("target_week")


def weeks_after(step: Column) -> Column:
    """``target_week`` of a forecast made in the row's week."""
    return F.date_add(DAY, (7 * step).cast("int")).alias("target_week")


def pivot_weeks(df: DataFrame, value: str, by: str, values: list | None = None) -> DataFrame:
    """Weeks as rows, the values of ``by`` as columns, sums as cells.

    For few columns such as product groups; thousands of products stay in long form.
    """
    return df.groupBy(DAY).pivot(by, values).agg(F.sum(value))
