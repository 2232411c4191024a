"""Attribute encodings for the feature frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yes_no(col: Column) -> Column:
    """'Y' -> 1, 'N' -> 0, anything else -> null."""
    return F.when(col == "Y", 1).when(col == "N", 0)


def flag(col: Column) -> Column:
    return col.cast("int")


def class_number(col: Column) -> Column:
    """Digits at positions 3-8 of a class code as a number; null when they are not digits."""
    return F.substring(col, 3, 6).try_cast("double")
