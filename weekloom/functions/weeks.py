"""Week and date expressions (native columns, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_first_day(week: Column, year: Column) -> Column:
    """Monday of a sales week, where week 1 is the week that holds January 1 (not ISO)."""
    jan1 = F.make_date(year, F.lit(1), F.lit(1))
    return F.date_add(jan1, ((week - 1) * 7 - F.weekday(jan1)).cast("int"))


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def calendar_year(day: Column) -> Column:
    """Calendar year; next to an ISO week the pair is inconsistent around New Year, as intended."""
    return F.year(day)


def weeks_between(first: Column, last: Column) -> Column:
    """Array of the days first, first + 7, ... up to last; empty when last is before first."""
    return F.when(
        first <= last, F.sequence(first, last, F.expr("interval 7 days"))
    ).otherwise(F.array().cast("array<date>"))
