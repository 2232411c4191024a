"""The global week calendar: gaps, repair of weeks no product has, newest weeks."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.config import DAY, ForecastConfig
from weekloom.functions.weeks import weeks_between
from weekloom.operators.fill import fill_weeks
from weekloom.operators.series import product_weeks, whole

WEEK = dt.timedelta(days=7)


def _weeks(df: DataFrame) -> DataFrame:
    """One row with the sorted array of all weeks present.

    Bounded by the calendar, not by the data: weeks are made distinct in parallel, and one task
    gathers each of them once.
    """
    return df.select(DAY).distinct().agg(F.array_sort(F.collect_set(DAY)).alias("weeks"))


def calendar_gaps(df: DataFrame) -> DataFrame:
    """Pairs of consecutive present weeks that are not seven days apart."""
    pairs = F.expr(
        "transform(sequence(1, greatest(size(weeks) - 1, 1)), "
        "i -> struct(get(weeks, i - 1) as week_before, get(weeks, i) as week_after))"
    )
    return (
        _weeks(df)
        .select(F.inline(pairs))
        .where(F.datediff("week_after", "week_before") != 7)
        .withColumn("days_apart", F.datediff("week_after", "week_before"))
    )


def missing_weeks(df: DataFrame) -> DataFrame:
    """Weeks between the first and the last one that no product has."""
    w = F.col("weeks")
    expected = weeks_between(F.element_at(w, 1), F.element_at(w, -1))
    return _weeks(df).where(F.size(w) > 0).select(F.explode(F.array_except(expected, w)).alias(DAY))


@dataclass(frozen=True)
class WeekCalendar:
    """First and last week after edge handling, the weeks in between that nobody has, and the
    largest week number."""

    first: dt.date
    last: dt.date
    missing: tuple[dt.date, ...]
    largest_number: int = 53

    def oldest_kept(self, n: int) -> dt.date:
        """First of the newest ``n`` weeks; after repair they are consecutive."""
        return max(self.first, self.last - (n - 1) * WEEK)

    def within(self, n: int) -> WeekCalendar:
        """The calendar without the gaps that the newest ``n`` weeks do not hold."""
        return replace(self, missing=tuple(d for d in self.missing if d >= self.oldest_kept(n)))

    def needed_from(self, n: int) -> dt.date:
        """First week that can influence the newest ``n``: the repair of a gap in them looks at all of history."""
        return self.first if self.within(n).missing else self.oldest_kept(n)

    def needed(self, n: int) -> Column:
        """Filter for those weeks, in a form the raw table can prune by.

        Weeks up to 53 begin in their year or just before it (larger numbers may reach later
        years), so earlier years are out. Stated on the raw column alone, this skips partitions
        and row groups of a table kept by year.
        """
        day = self.needed_from(n)
        reach = 7 * (self.largest_number - 1) // 365
        return (F.col("sales_year") >= day.year - reach) & (F.col(DAY) >= F.lit(day))


def week_calendar(rows: DataFrame, cfg: ForecastConfig) -> WeekCalendar | None:
    """Look the calendar up (one small row); None without rows.

    With ``edge_gap="drop"`` an outermost week that is not next to another one is left out, on
    either side, before interior gaps are listed. Knowing the weeks while the plan is built means
    no repair step where nothing is missing, and plain filters that reach the scan.
    """
    seen = rows.groupBy(DAY).agg(F.max("sales_week").alias("number"))
    row = seen.agg(F.array_sort(F.collect_set(DAY)).alias("weeks"), F.max("number").alias("number")).first()
    weeks = row["weeks"]
    if not weeks:
        return None
    if cfg.edge_gap == "drop" and len(weeks) >= 3:
        head = weeks[1] - weeks[0] != WEEK
        tail = weeks[-1] - weeks[-2] != WEEK
        weeks = weeks[int(head) : len(weeks) - int(tail)]
    span = range((weeks[-1] - weeks[0]) // WEEK + 1)
    present = set(weeks)
    missing = tuple(d for d in (weeks[0] + i * WEEK for i in span) if d not in present)
    return WeekCalendar(weeks[0], weeks[-1], missing, row["number"])


def repair_missing_weeks(df: DataFrame, cfg: ForecastConfig, calendar: WeekCalendar | None = None) -> DataFrame:
    """Give every product a row in each week that is missing for all products.

    Products with at least ``gap_neighbour_weeks`` weeks get the mean of their nearest earlier and
    later row (a copy when only one exists); the others get a zero row. Without a gap the rows stay
    as they are, but for an isolated outermost week. ``calendar`` may come from the rows before
    merging, which have the same weeks.
    """
    calendar = calendar or week_calendar(df, cfg)
    if calendar is None:
        return df
    kept = df.where(F.col(DAY).between(F.lit(calendar.first), F.lit(calendar.last)))
    if not calendar.missing:
        return kept
    w = product_weeks()
    marked = kept.withColumns(
        {
            "_neighbours": F.count("*").over(whole(w)) >= cfg.gap_neighbour_weeks,
            "_next_day": F.lead(DAY).over(w),
        }
    )
    missing = F.array(*[F.lit(d) for d in calendar.missing])
    until = F.col("_next_day")
    after = F.filter(missing, lambda d: (d > F.col(DAY)) & (until.isNull() | (d < until)))
    before = F.filter(missing, lambda d: d < F.col(DAY))
    return fill_weeks(marked, before, after, F.col("_neighbours")).select(df.columns)


def last_n_weeks(df: DataFrame, n: int, calendar: WeekCalendar | None = None) -> DataFrame:
    """Rows of the newest ``n`` distinct weeks.

    A ``calendar`` stands for repaired rows and gives the cut by arithmetic; otherwise the distinct
    weeks of ``df`` are looked up within the query.
    """
    if calendar is not None:
        return df.where(F.col(DAY) >= F.lit(calendar.oldest_kept(n)))
    oldest = _weeks(df).select(
        F.element_at("weeks", -F.least(F.lit(n), F.greatest(F.size("weeks"), F.lit(1)))).alias("oldest")
    )
    return df.where(F.col(DAY) >= oldest.scalar())

