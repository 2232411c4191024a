"""Raw weekly rows to the complete and the filtered demand tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.config import DAY, ForecastConfig
from weekloom.operators.calendar import last_n_weeks, repair_missing_weeks, week_calendar
from weekloom.operators.complete import complete
from weekloom.operators.merge import merge_duplicate_weeks
from weekloom.operators.outliers import replace_outliers, upper_limits
from weekloom.operators.quality import cast_measures, drop_nulls, with_first_day
from weekloom.operators.rotation import drop_rare_products, rotation_flag
from weekloom.session import stage
from weekloom.sources.tables import write_series_table, write_table


def typed_rows(raw: DataFrame) -> DataFrame:
    """Null-free rows with numeric measures and the Monday of their week."""
    return with_first_day(cast_measures(drop_nulls(raw, raw.columns)))


def clean(raw: DataFrame) -> DataFrame:
    """Typed rows, one per (product, week)."""
    return merge_duplicate_weeks(typed_rows(raw))


def prepare(raw: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Merged, calendar repaired, newest weeks only, rotation flagged, rare products gone.

    The raw rows are read once: merged weeks, a row for each product and week, are staged, and the calendar
    comes from their day column. History before the kept weeks is read again only if a gap among these has to be
    repaired from it. There are two shuffles: pre-aggregated rows for the merge, then merged rows by product for
    every window that follows.
    """
    merged = stage(clean(raw), "merged")
    calendar = week_calendar(merged, cfg)
    if calendar is not None:
        calendar = calendar.within(cfg.keep_weeks)
        merged = merged.where(F.col(DAY) >= F.lit(calendar.needed_from(cfg.keep_weeks)))
    repaired = repair_missing_weeks(merged, cfg, calendar)
    recent = last_n_weeks(repaired, cfg.keep_weeks, calendar)
    return drop_rare_products(rotation_flag(recent, cfg), cfg)


def demand_prepared(raw: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """The table before filling, staged: filling reads it twice (week span, rows) and the outlier
    limits a third time, while the raw scan and its shuffles run once."""
    return stage(prepare(raw, cfg), "prepared")


def demand_complete(raw: DataFrame, cfg: ForecastConfig) -> DataFrame:
    return complete(demand_prepared(raw, cfg))


def demand_filtered(raw: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Complete table with the outliers of the three measures replaced."""
    prepared = demand_prepared(raw, cfg)
    return replace_outliers(complete(prepared), upper_limits(prepared, cfg)).drop("all_outliers")


def build_tables(raw: DataFrame, cfg: ForecastConfig) -> None:
    """Write the ``FINAL`` and ``Filtered`` tables of the country.

    The forecasters read ``Filtered`` by product: it is bucketed and sorted, so none of them shuffles it.
    """
    prepared = demand_prepared(raw, cfg)
    write_table(complete(prepared), cfg.table("FINAL"))
    final = raw.sparkSession.table(cfg.table("FINAL"))
    filtered = replace_outliers(final, upper_limits(prepared, cfg)).drop("all_outliers")
    write_series_table(filtered, cfg.table("Filtered"), cfg.series_buckets)

