import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from frames import ATTRS, demand, monday, values
from pyspark.sql import functions as F

from weekloom.config import MEASURES, QTY, ForecastConfig
from weekloom.functions.encode import class_number, yes_no
from weekloom.functions.weeks import week_first_day
from weekloom.operators.calendar import calendar_gaps, last_n_weeks, missing_weeks, repair_missing_weeks, week_calendar
from weekloom.operators.complete import (
    attach_attributes,
    complete,
    fill_high_rotation,
    fill_low_rotation,
    grid_completeness,
    rank_real_over_filler,
    union_completed,
    week_product_grid,
)
from weekloom.operators.explore import binned_density, density_grid
from weekloom.operators.merge import duplicate_weeks, merge_duplicate_weeks
from weekloom.operators.outliers import replace_outliers, upper_limits
from weekloom.operators.quality import cast_measures, cast_rejects, drop_nulls, null_audit, with_first_day
from weekloom.operators.rotation import drop_rare_products, rotation_flag, rotation_summary
from weekloom.operators.series import series_arrays
from weekloom.plans.preparation import build_tables, clean, demand_complete, demand_filtered, prepare
from weekloom.sources.tables import DEMAND_SCHEMA, scan_demand, scan_filtered, write_parquet, write_series_table, write_table

CFG = ForecastConfig(min_rotation=2, keep_weeks=10, high_rotation_weeks=5, gap_neighbour_weeks=5)


def flagged(df, high):
    return df.withColumn("Forte_rotation", F.col("product_id").isin(*high))


def test_week_first_day_is_the_monday_of_the_week_that_holds_january_first(spark):
    rows = [(1, 2020), (1, 2021), (53, 2020), (1, 2022), (2, 2022)]
    df = spark.createDataFrame(rows, "w int, y int")
    got = [r[0] for r in df.select(week_first_day(F.col("w"), F.col("y"))).collect()]
    assert got == [
        dt.date(2019, 12, 30),
        dt.date(2020, 12, 28),
        dt.date(2020, 12, 28),
        dt.date(2021, 12, 27),
        dt.date(2022, 1, 3),
    ]


def test_encodings(spark):
    df = spark.createDataFrame([("Y", "EC000123"), ("N", "ECxx01"), ("?", None)], "s string, c string")
    got = [tuple(r) for r in df.select(yes_no(F.col("s")), class_number(F.col("c"))).collect()]
    assert got == [(1, 123.0), (0, None), (None, None)]


def test_null_audit_counts_products_where_all_null_columns_are_null(spark):
    df = spark.createDataFrame(
        [(1, None, None), (1, 2.0, 1.0), (2, None, 1.0), (3, 1.0, 1.0)], "product_id long, a double, b double"
    )
    got = {r[0]: (r[1], r[2]) for r in null_audit(df, ["product_id", "a", "b"]).collect()}
    assert got["a"][0] == 2 and got["b"][0] == 1 and got["product_id"][0] == 0
    assert got["a"][1] == pytest.approx(100 / 3)
    clean_rows = df.where("product_id = 3")
    assert {r[2] for r in null_audit(clean_rows, ["a", "b"]).collect()} == {0.0}
    assert drop_nulls(df, ["a"]).count() == 2
    nan = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "product_id long, a double")
    assert {r[0]: r[1] for r in null_audit(nan, ["a"]).collect()} == {"a": 1}
    assert drop_nulls(nan, ["product_id", "a"]).count() == 1


def test_cast_raises_or_rejects_bad_text(spark):
    df = demand(spark, [(1, 0, 5)]).withColumn(QTY, F.lit("5 pcs"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cast_measures(df).collect()
    assert cast_measures(df, on_bad="null").first()[QTY] is None
    assert cast_rejects(df).first()[QTY] == 1


def test_new_year_halves_merge(spark):
    rows = [
        {"product_id": 1, "sales_year": y, "sales_week": w, "total_qty": q, "avg_sales_price": p,
         "total_discount_value": 1.0, "sales_date_weekly_number": 2, **ATTRS, "vendor_id": v}
        for y, w, q, p, v in [(2021, 1, 3.0, 10.0, 9), (2020, 53, 4.0, 20.0, 3)]
    ]
    df = with_first_day(spark.createDataFrame(rows, DEMAND_SCHEMA))
    assert duplicate_weeks(df).collect()[0]["n_rows"] == 2
    (row,) = merge_duplicate_weeks(df).collect()
    assert (row["total_qty"], row["avg_sales_price"], row["total_discount_value"]) == (7.0, 15.0, 2.0)
    assert row["sales_date_weekly_number"] == 4
    assert (row["sales_year"], row["sales_week"], row["vendor_id"]) == (2020, 53, 3)
    assert row["First_day"] == dt.date(2020, 12, 28)


def test_repair_fills_global_gap_by_neighbours_or_zero(spark):
    often = [(1, w, 10 * w) for w in (0, 1, 2, 3, 6, 7)]
    seldom = [(2, w, 5) for w in (1, 7)]
    starts_late = [(3, w, w) for w in (6, 7, 8, 9, 10)]
    df = demand(spark, often + seldom + starts_late)
    assert sorted(r[0] for r in missing_weeks(df).collect()) == [monday(4), monday(5)]
    (gap,) = calendar_gaps(df).collect()
    assert (gap["week_before"], gap["week_after"], gap["days_apart"]) == (monday(3), monday(6), 21)
    fixed = repair_missing_weeks(df, CFG)
    got = values(fixed)
    assert got[1, 4] == got[1, 5] == 45.0  # both from rows 3 and 6
    assert got[2, 4] == got[2, 5] == 0.0
    assert got[3, 4] == got[3, 5] == 6.0  # one side only: copied
    assert len(got) == 6 + 2 + 5 + 6
    assert values(repair_missing_weeks(fixed, CFG)) == got  # nothing left to do
    row = fixed.where((F.col("product_id") == 1) & (F.col("First_day") == monday(4))).first()
    assert (row["sales_week"], row["sales_year"]) == (monday(4).isocalendar()[1], monday(4).year)


def test_isolated_outermost_weeks_are_dropped_or_filled(spark):
    df = demand(spark, [(1, w, w) for w in (0, 2, 3, 4, 5, 6, 9)])
    assert {w for _, w in values(repair_missing_weeks(df, CFG))} == {2, 3, 4, 5, 6}
    kept = repair_missing_weeks(df, replace(CFG, edge_gap="fill"))
    assert {w for _, w in values(kept)} == set(range(10))
    assert values(kept)[1, 1] == 1.0 and values(kept)[1, 7] == 7.5


def test_without_a_gap_repair_changes_nothing(spark):
    df = demand(spark, [(1, w, w) for w in range(8)] + [(2, 3, 1)])
    assert values(repair_missing_weeks(df, CFG)) == values(df)
    assert repair_missing_weeks(df.limit(0), CFG).count() == 0


def test_newest_weeks_and_rotation(spark):
    df = demand(spark, [(1, w, 1) for w in range(12)] + [(2, w, 1) for w in (0, 1, 2, 10)] + [(3, w, 1) for w in (5, 6)])
    recent = last_n_weeks(df, CFG.keep_weeks)
    assert min(w for _, w in values(recent)) == 2
    marked = rotation_flag(recent, CFG)
    assert {(p, f) for (p, _), f in values(marked, "Forte_rotation").items()} == {(1, True), (2, False), (3, False)}
    summary = rotation_summary(marked, CFG).first()
    assert tuple(summary) == (3, 1, 2, 2)
    assert {p for p, _ in values(drop_rare_products(marked, CFG))} == {1}


def test_fill_and_completeness(spark):
    high = [(1, 0, 4, 2), (1, 2, 8, 3), (1, 3, 8, 3), (1, 7, 20, 8)]
    low = [(2, 3, 6), (2, 4, 2), (2, 9, 1)]
    always = [(3, w, 1) for w in range(10)]
    df = flagged(demand(spark, high + low + always), [1, 3])
    full = complete(df)
    got = values(full)
    assert len(got) == 30
    assert got[1, 1] == 6.0
    assert got[1, 4] == got[1, 5] == got[1, 6] == 14.0
    assert got[1, 8] == got[1, 9] == 20.0
    assert [got[2, w] for w in range(10)] == [0, 0, 0, 6, 2, 0, 0, 0, 0, 1]
    counts = values(full, "sales_date_weekly_number")
    assert counts[1, 1] == 2  # 2.5 rounds to even
    assert counts[1, 4] == 6  # 5.5 rounds to even
    assert {r["is_complete"] for r in grid_completeness(full, df).collect()} == {True}
    assert full.where("sis_sub_family is null or vendor_id is null").count() == 0
    again = complete(full)
    assert values(again) == got


def test_low_rotation_two_ways_and_union(spark):
    df = flagged(demand(spark, [(1, w, w) for w in range(6)] + [(2, 1, 6), (2, 4, 2)]), [1])
    low = fill_low_rotation(df)
    assert values(rank_real_over_filler(df)) == values(low)
    assert week_product_grid(df).count() == 6
    high = fill_high_rotation(df)
    both = union_completed(low.drop("sales_week"), high)
    assert both.where("sales_week is null").count() == low.count()
    assert values(attach_attributes(both.select("product_id", "First_day"), df), "vendor_id")[2, 0] == 3


def test_attributes_come_from_the_newest_week(spark):
    old = demand(spark, [(1, w, 1) for w in range(3)], vendor_id=1)
    new = demand(spark, [(1, 4, 1)], vendor_id=2)
    df = flagged(old.unionByName(new), [1])
    assert set(values(complete(df), "vendor_id").values()) == {2}
    assert set(values(attach_attributes(df.select("product_id", "First_day"), df), "vendor_id").values()) == {2}


def test_outliers_take_the_mean_of_normal_neighbours(spark):
    cells = [(1, w, q) for w, q in enumerate([50, 1, 60, 70, 4, 50])] + [(2, w, 99) for w in range(4)]
    df = demand(spark, cells)
    limits = spark.range(1).select(F.struct(F.lit(50.0).alias(QTY))).scalar()
    out = replace_outliers(df, limits, (QTY,))
    got = values(out)
    assert [got[1, w] for w in range(6)] == [1.0, 1.0, 2.5, 2.5, 4.0, 4.0]
    assert [got[2, w] for w in range(4)] == [99.0] * 4  # no normal value to take
    assert set(values(out, "all_outliers").items()) >= {((2, 0), True), ((1, 0), False)}
    assert out.count() == df.count()


def test_outlier_limit_uses_population_sigma(spark):
    df = demand(spark, [(1, 0, 1), (1, 1, 3)])
    limit = spark.range(1).select(upper_limits(df, ForecastConfig(sigma=3.0))[QTY]).first()[0]
    assert limit == pytest.approx(2 + 3 * 1)


def raw_rows(spark, cells=None):
    if cells is None:
        cells = [(1, w, 5 + w % 3) for w in range(40)] + [(2, w, 2) for w in range(0, 40, 3)] + [(3, 4, 1)]
        cells += [(1, 39, 500)]
    df = demand(spark, cells)
    # week numbers of the calendar that starts in the week of January 1
    jan1 = F.trunc("First_day", "year")
    first = F.date_sub(jan1, F.weekday(jan1))
    week = (F.datediff("First_day", first) / 7 + 1).cast("int")
    return df.withColumn("sales_week", week).select(DEMAND_SCHEMA.fieldNames())


def test_whole_preparation_and_tables(spark, tmp_path):
    cfg = replace(CFG, keep_weeks=30, high_rotation_weeks=20, country="TST")
    raw = raw_rows(spark)
    base = prepare(raw, cfg)
    assert {(p, f) for (p, _), f in values(base, "Forte_rotation").items()} == {(1, True), (2, False)}
    full = demand_complete(raw, cfg)
    assert full.count() == 60
    clear = demand_filtered(raw, cfg)
    assert clear.count() == 60
    limits = base.agg(*[(F.avg(c) + 3 * F.stddev_pop(c)).alias(c) for c in MEASURES]).first()
    top = clear.agg(*[F.max(c).alias(c) for c in MEASURES]).first()
    assert all(top[c] < limits[c] for c in MEASURES)
    assert clean(raw).count() == raw.count() - 1

    write_table(raw, cfg.table())
    build_tables(scan_demand(spark, cfg), cfg)
    assert sorted(map(tuple, scan_filtered(spark, cfg).select(clear.columns).collect())) == sorted(
        map(tuple, clear.collect())
    )
    write_table(full, "weekly_by_group", partition_by="sis_group_id")
    assert spark.table("weekly_by_group").count() == 60
    write_parquet(raw, str(tmp_path / "raw"))
    write_parquet(full, str(tmp_path / "groups"), partition_by="sis_group_id")
    assert spark.read.parquet(str(tmp_path / "groups")).where("sis_group_id = 1").count() == 60
    assert scan_demand(spark, cfg, str(tmp_path / "raw")).count() == raw.count()
    write_series_table(full, "weekly_series", 3)
    windows = rotation_flag(spark.table("weekly_series").drop("Forte_rotation"), cfg)
    assert "Exchange" not in windows._jdf.queryExecution().executedPlan().toString()


def test_years_are_pruned_in_the_scan(spark, tmp_path):
    cells = [(p, w, w) for p in (1, 2) for w in range(160)]
    rows = raw_rows(spark, cells)
    rows.write.partitionBy("sales_year").parquet(str(tmp_path / "raw"))
    raw = with_first_day(spark.read.schema(DEMAND_SCHEMA).parquet(str(tmp_path / "raw")))
    calendar = week_calendar(raw, CFG)
    assert (calendar.first, calendar.last, calendar.missing) == (monday(0), monday(159), ())
    df = raw.where(calendar.needed(30))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sales_year" in plan and ">= 2022)" in plan
    assert values(df) == values(raw.where(F.col("First_day") >= F.lit(monday(130))))
    # week numbers beyond 53 reach into later years and must not be lost
    odd = raw.withColumns({"sales_year": F.col("sales_year") - 1, "sales_week": F.col("sales_week") + 52})
    odd = with_first_day(odd)
    kept = odd.where(week_calendar(odd, CFG).needed(30))
    assert kept.select("First_day").distinct().count() == 30


def test_a_product_with_most_rows_is_reduced_before_the_shuffle(spark):
    cells = [(1, w, 1) for w in range(12)] * 300 + [(p, w, 1) for p in range(2, 8) for w in range(12)]
    df = demand(spark, cells).repartition(4)
    merged = merge_duplicate_weeks(df)
    got = values(merged)
    assert got[1, 3] == 300.0 and got[5, 3] == 1.0 and len(got) == 7 * 12
    plan = merged._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning(product_id") :]
    assert "partial_sum" in below  # partial sums under the shuffle
    assert values(prepare(df.drop("First_day"), CFG))[1, 3] == 300.0


def test_one_shuffle_by_product_after_the_merge(spark):
    plan = prepare(raw_rows(spark), CFG)._jdf.queryExecution().executedPlan().toString()
    main = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    by_product = [line for line in main if "hashpartitioning(product_id" in line and "First_day" not in line.split("),")[0]]
    assert len(by_product) == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_preparation_reads_the_raw_rows_once(spark):
    """The calendar, the merge and a repair all come from one pass over the raw table."""
    rows = raw_rows(spark, [(p, w, w + p) for p in (1, 2) for w in range(60) if w not in (20, 55)])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    cfg = replace(CFG, keep_weeks=30, min_rotation=5)
    raw = rows.mapInArrow(counted, rows.schema)
    once = demand_complete(raw, cfg)
    assert once.count() == 2 * 30 and read.value == rows.count()
    # Week 55 is repaired, week 20 lies before the kept weeks.
    got = values(prepare(rows, cfg))
    assert got[1, 55] == (54 + 1 + 56 + 1) / 2 and min(w for _, w in got) == 30


def test_gaps_before_the_kept_weeks_need_no_history(spark):
    rows = with_first_day(raw_rows(spark, [(1, w, w) for w in range(60) if w not in (20, 55)]))
    calendar = week_calendar(rows, CFG)
    assert calendar.missing == (monday(20), monday(55))
    assert calendar.within(30).missing == (monday(55),) and calendar.needed_from(30) == monday(0)
    assert calendar.within(4).missing == () and calendar.needed_from(4) == monday(56)


def test_forecasters_read_the_filtered_table_without_a_shuffle(spark):
    cfg = replace(CFG, country="BKT", series_buckets=3, min_rotation=5)
    build_tables(raw_rows(spark, [(p, w, w + p) for p in (1, 2, 3) for w in range(60)]), cfg)
    series = series_arrays(scan_filtered(spark, cfg), "total_qty", "sis_group_id")
    assert "Exchange" not in series._jdf.queryExecution().executedPlan().toString()
    assert {r["product_id"]: len(r["y"]) for r in series.collect()} == {1: 10, 2: 10, 3: 10}


def test_binned_density_stays_within_its_bound(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(v),) for v in rng.gamma(2.0, 7.0, 3000)] + [(None,)], "total_qty double")
    exact = {r["point"]: r["density"] for r in density_grid(df).collect()}
    for cells in (64, 1024):
        got = binned_density(df, cells=cells).collect()
        bound = got[0]["error_bound"]
        assert len(got) == 100 and max(abs(r["density"] - exact[r["point"]]) for r in got) <= bound
    assert bound < 1e-4
