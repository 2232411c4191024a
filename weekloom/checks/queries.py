"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.checks.inputs import (
    CFG,
    EDGE_GAP,
    INTERIOR_GAP,
    filtered,
    once,
    prepared,
    raw,
    raw_text,
    raw_with_nulls,
    raw_without_weeks,
    tidy,
)
from weekloom.config import DAY, FLAG, GROUP, KEY, MEASURES, QTY
from weekloom.functions.weeks import calendar_year, iso_week
from weekloom.models import arima, forest, naive, ridge, stationarity, var, window
from weekloom.operators import (
    calendar,
    complete,
    explore,
    features,
    merge,
    metrics,
    outliers,
    quality,
    rotation,
    scaling,
    variation,
)
from weekloom.operators.gram import series_length
from weekloom.operators.series import pivot_weeks
from weekloom.operators.series import series_arrays as arrays_per_product
from weekloom.plans import evaluation, preparation
from weekloom.session import stage, staging_dir
from weekloom.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- scans, data quality, dates -----------------------------------------------------------------


@once
def _raw_folder(spark, d):
    """The raw table in a folder of its own, written by the library's sink."""
    path = f"{staging_dir(spark)}/weekloom/raw-{uuid.uuid4().hex}"
    tables.write_parquet(raw(spark, d), path, "sis_group_id")
    return path


@query
def scan_demand(spark, d):
    return tidy(tables.scan_demand(spark, CFG, _raw_folder(spark, d)))


@query
def filtered_table(spark, d):
    """The table that the forecasters read, written bucketed by product and read back."""
    cfg = replace(CFG, country=f"CHECK{uuid.uuid4().hex[:12]}", series_buckets=4)
    preparation.build_tables(raw(spark, d), cfg)
    return tidy(tables.scan_filtered(spark, cfg))


@query
def null_audit(spark, d):
    df = raw_with_nulls(spark, d)
    return tidy(quality.null_audit(df, df.columns))


@query
def drop_nulls(spark, d):
    df = raw_with_nulls(spark, d)
    return tidy(quality.drop_nulls(df, df.columns))


@query
def cast_measures(spark, d):
    return tidy(quality.cast_measures(raw_text(spark, d)).select(KEY, "sales_year", "sales_week", *MEASURES))


@query
def cast_rejects(spark, d):
    bad = F.col("sales_week") == 7
    df = raw_text(spark, d).withColumn(QTY, F.when(bad, F.concat(F.col(QTY), F.lit(" pcs"))).otherwise(F.col(QTY)))
    return quality.cast_rejects(df)


@query
def week_first_day(spark, d):
    return tidy(quality.with_first_day(raw(spark, d)).select("sales_year", "sales_week", DAY).distinct())


@query
def iso_week_parts(spark, d):
    days = preparation.typed_rows(raw(spark, d)).select(DAY).distinct()
    return tidy(
        days.select(DAY, iso_week(F.col(DAY)).alias("iso_week"), calendar_year(F.col(DAY)).alias("calendar_year"))
    )


@query
def encode_attributes(spark, d):
    cols = ["is_stock_numeric", "FR_numeric", "etim_class_numeric"]
    return tidy(features.encode_attributes(prepared(spark, d)).select(KEY, DAY, *cols))


# --- calendar, duplicates, rotation --------------------------------------------------------------


@query
def duplicate_weeks(spark, d):
    return tidy(merge.duplicate_weeks(preparation.typed_rows(raw(spark, d))))


@query
def merge_duplicate_weeks(spark, d):
    return tidy(preparation.clean(raw(spark, d)))


@query
def calendar_gaps(spark, d):
    return tidy(calendar.calendar_gaps(preparation.typed_rows(raw_without_weeks(spark, d, INTERIOR_GAP))))


@query
def missing_weeks(spark, d):
    return tidy(calendar.missing_weeks(preparation.typed_rows(raw_without_weeks(spark, d, INTERIOR_GAP))))


@query
def repair_missing_weeks(spark, d):
    df = preparation.clean(raw_without_weeks(spark, d, INTERIOR_GAP))
    return tidy(calendar.repair_missing_weeks(df, CFG))


@query
def repair_edge_gap(spark, d):
    df = preparation.clean(raw_without_weeks(spark, d, EDGE_GAP))
    fixed = calendar.repair_missing_weeks(df, CFG)
    return tidy(fixed.groupBy(DAY).agg(F.count("*").alias("n_rows"), F.sum(QTY).alias(QTY)))


@query
def last_n_weeks(spark, d):
    return tidy(calendar.last_n_weeks(preparation.clean(raw(spark, d)), CFG.keep_weeks))


def _flagged(spark, d):
    recent = calendar.last_n_weeks(preparation.clean(raw(spark, d)), CFG.keep_weeks)
    return rotation.rotation_flag(recent, CFG)


@query
def rotation_flag(spark, d):
    return tidy(_flagged(spark, d).select(KEY, DAY, FLAG))


@query
def rotation_summary(spark, d):
    return rotation.rotation_summary(_flagged(spark, d), CFG)


@query
def drop_rare_products(spark, d):
    return tidy(rotation.drop_rare_products(_flagged(spark, d), CFG).select(KEY, DAY, QTY, FLAG))


@query
def demand_prepared(spark, d):
    return tidy(preparation.prepare(raw(spark, d), CFG))


# --- filling -------------------------------------------------------------------------------------


@query
def week_product_grid(spark, d):
    return tidy(complete.week_product_grid(prepared(spark, d)))


@query
def rank_real_over_filler(spark, d):
    return tidy(complete.rank_real_over_filler(prepared(spark, d)))


@query
def fill_low_rotation(spark, d):
    return tidy(complete.fill_low_rotation(prepared(spark, d)))


@query
def fill_high_rotation(spark, d):
    return tidy(complete.fill_high_rotation(prepared(spark, d)))


@query
def union_completed(spark, d):
    base = prepared(spark, d)
    low = complete.fill_low_rotation(base).drop(FLAG, "sales_week", "sales_year")
    both = complete.union_completed(low, complete.fill_high_rotation(base))
    return tidy(
        both.withColumns(
            {
                FLAG: F.coalesce(F.col(FLAG).cast("string"), F.lit("none")),
                "sales_week": F.coalesce("sales_week", F.lit(-1)),
                "sales_year": F.coalesce("sales_year", F.lit(-1)),
            }
        )
    )


@query
def attach_attributes(spark, d):
    base = prepared(spark, d)
    low = complete.fill_low_rotation(base)
    return tidy(complete.attach_attributes(low.select(KEY, DAY, QTY), base))


@query
def grid_completeness(spark, d):
    base = prepared(spark, d)
    return complete.grid_completeness(complete.complete(base), base)


@query
def demand_complete(spark, d):
    return tidy(preparation.demand_complete(raw(spark, d), CFG))


# --- outliers ------------------------------------------------------------------------------------


@query
def outlier_limits(spark, d):
    return tidy(outliers.outlier_limits(prepared(spark, d), CFG), single=("mean", "sd", "lower", "upper"))


@query
def outlier_rows(spark, d):
    base = prepared(spark, d)
    return tidy(outliers.outlier_rows(complete.complete(base), QTY, base, CFG).select(KEY, DAY, QTY))


@query
def replace_outliers_qty(spark, d):
    base = prepared(spark, d)
    limits = outliers.upper_limits(base, CFG, (QTY,))
    return tidy(outliers.replace_outliers(complete.complete(base), limits, (QTY,)).select(KEY, DAY, QTY, "all_outliers"))


@query
def demand_filtered(spark, d):
    return tidy(preparation.demand_filtered(raw(spark, d), CFG))


# --- features ------------------------------------------------------------------------------------


@query
def lag_features(spark, d):
    df = features.date_split(filtered(spark, d), CFG).select(KEY, DAY, "split", QTY)
    return tidy(features.lag_features(df, CFG.steps, "split"))


@query
def rolling_mean(spark, d):
    df = features.date_split(filtered(spark, d), CFG).select(KEY, DAY, "split", QTY)
    return tidy(features.rolling_mean(df, CFG.steps[-3:], "split"))


@query
def lead_targets(spark, d):
    df = features.date_split(filtered(spark, d), CFG).select(KEY, DAY, "split", QTY)
    return tidy(features.lead_targets(df, CFG.steps, "split"))


@query
def first_difference(spark, d):
    return tidy(features.first_difference(filtered(spark, d).select(KEY, DAY, QTY)))


@query
def invert_difference(spark, d):
    """Differences of the last 30 weeks summed back onto the last train value give the values."""
    df = filtered(spark, d).select(KEY, DAY, QTY)
    parts = features.last_split(features.first_difference(df), CFG.var_test)
    first = parts.where("part = 'test'").groupBy(KEY).agg(F.min(DAY).alias("start"))
    steps = (
        parts.where("part = 'test'")
        .join(first, KEY)
        .select(KEY, (F.datediff(DAY, "start") / 7 + 1).cast("int").alias("step"), F.col(f"diff_{QTY}").alias("yhat"))
    )
    last = parts.where("part = 'train'").groupBy(KEY).agg(F.max_by(QTY, DAY).alias("last_value"))
    return tidy(features.invert_difference(steps, last))


@query
def date_split(spark, d):
    df = features.date_split(filtered(spark, d), CFG)
    return tidy(df.groupBy("split").agg(F.count("*").alias("n_rows"), F.min(DAY).alias("first"), F.max(DAY).alias("last")))


@query
def train_test_split(spark, d):
    return tidy(features.share_split(filtered(spark, d).select(KEY, DAY, QTY), CFG.train_share))


@query
def train_valid_test_split(spark, d):
    df = features.position_split(filtered(spark, d).select(KEY, DAY, QTY), CFG.ridge_train, CFG.ridge_valid)
    return tidy(df.groupBy(KEY, "part").agg(F.count("*").alias("n_rows"), F.sum(QTY).alias(QTY)))


@query
def last_rows_split(spark, d):
    df = features.last_split(filtered(spark, d).select(KEY, DAY, QTY), CFG.var_test)
    return tidy(df.groupBy(KEY, "part").agg(F.count("*").alias("n_rows"), F.min(DAY).alias("first")))


@query
def features_one_step(spark, d):
    return tidy(features.one_step_features(filtered(spark, d), CFG))


@query
def features_multi_step(spark, d):
    return tidy(features.multi_step_features(filtered(spark, d), CFG))


@query
def window_samples(spark, d):
    """Inputs as first, last and sum; targets as columns."""
    df = features.window_samples(filtered(spark, d), CFG)
    return tidy(
        df.select(
            KEY,
            "i",
            F.element_at("x", 1).alias("x_first"),
            F.element_at("x", -1).alias("x_last"),
            F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("x_sum"),
            *[F.element_at("target", j + 1).alias(f"target_{s}") for j, s in enumerate(CFG.steps)],
        )
    )


@query
def series_arrays(spark, d):
    """The arrays by their length, ends and sum."""
    df = arrays_per_product(filtered(spark, d), QTY)
    return tidy(
        df.select(
            KEY,
            "n",
            "first_week",
            "last_week",
            F.element_at("y", 1).alias("y_first"),
            F.element_at("y", -1).alias("y_last"),
            F.aggregate("y", F.lit(0.0), lambda a, b: a + b).alias("y_sum"),
        )
    )


@query
def pivot_week_group(spark, d):
    """Weeks by product groups, the groups being those of the data; the cells of the wide table as rows."""
    wide = pivot_weeks(filtered(spark, d), QTY, GROUP)
    return tidy(wide.unpivot([DAY], [F.col(f"`{c}`") for c in wide.columns if c != DAY], "grp", QTY))


@query
def impute_mean(spark, d):
    cols = [f"lag_{QTY}_1", f"diff_{QTY}_1", "mean_tqs_4"]
    df = features.one_step_features(filtered(spark, d), CFG)
    return tidy(scaling.impute_mean(df, cols, F.col("split") == "train").select(KEY, DAY, *cols))


@query
def scale_by_group(spark, d):
    return tidy(scaling.scale(filtered(spark, d), QTY, GROUP).select(KEY, DAY, QTY, "mu", "sd"))


@query
def scale_by_product(spark, d):
    return tidy(scaling.scale(filtered(spark, d), QTY, KEY).select(KEY, DAY, QTY, "mu", "sd"))


@query
def unscale_by_product(spark, d):
    scaled = scaling.scale(filtered(spark, d), QTY, KEY).select(KEY, DAY, QTY, "mu", "sd")
    return tidy(scaling.unscale(scaled, [QTY]))


# --- variation, simple forecasts, scores ---------------------------------------------------------


@query
def demand_cov(spark, d):
    return tidy(variation.demand_cov(filtered(spark, d), CFG))


@query
def dickey_fuller_lag0(spark, d):
    return tidy(variation.dickey_fuller_lag0(filtered(spark, d)))


# --- exploration ---------------------------------------------------------------------------------


@query
def describe_measures(spark, d):
    return tidy(explore.describe_measures(filtered(spark, d)), single=("mean", "max", "min"))


@query
def attribute_hierarchy(spark, d):
    return explore.attribute_hierarchy(filtered(spark, d))


@query
def measure_correlation(spark, d):
    return tidy(explore.measure_correlation(filtered(spark, d)))


@query
def density_grid(spark, d):
    return tidy(explore.density_grid(filtered(spark, d)))


@query
def density_binned(spark, d):
    return tidy(explore.binned_density(filtered(spark, d), cells=512))


@query
def seasonal_index(spark, d):
    return tidy(explore.seasonal_index(filtered(spark, d)))


@query
def autocorrelation(spark, d):
    return tidy(explore.autocorrelation(filtered(spark, d)))


# --- forecasts that SQL can follow exactly, and their scores ----------------------------------------


def _naive(spark, d):
    return naive.forecast_naive(filtered(spark, d), CFG)


@query
def naive_forecast(spark, d):
    return tidy(_naive(spark, d).drop("target_week"))


def _mean_or_last(spark, d):
    df = filtered(spark, d)
    return arima.mean_or_last_forecast(df, variation.dickey_fuller_lag0(df), CFG)


@query
def arima_mean_or_last(spark, d):
    return tidy(_mean_or_last(spark, d).drop("target_week", "order"))


@query
def metrics_total(spark, d):
    return tidy(metrics.score(_naive(spark, d), []))


@query
def metrics_by_step(spark, d):
    return tidy(metrics.score(_naive(spark, d), ["step"]))


@query
def metrics_by_group_step(spark, d):
    return tidy(metrics.scores_by_group_and_total(_naive(spark, d), CFG.steps))


@query
def metrics_by_product(spark, d):
    return tidy(metrics.score(_mean_or_last(spark, d), [KEY]))


@query
def step_group_table(spark, d):
    scores = metrics.scores_by_group_and_total(_naive(spark, d), CFG.steps)
    table = metrics.step_group_table(scores, "wmape")
    return tidy(table.unpivot(["step"], [F.col(f"`{c}`") for c in table.columns if c != "step"], "grp", "wmape"))


@query
def aligned_actuals(spark, d):
    """Last value before the test weeks against their actual values, joined by position."""
    df = filtered(spark, d)
    start = CFG.ridge_train + CFG.ridge_valid
    known = features.position_split(df, CFG.ridge_train, CFG.ridge_valid).where("part <> 'test'")
    last = known.groupBy(KEY).agg(F.max_by(QTY, DAY).alias("yhat"))
    steps = F.explode(F.array(*[F.lit(s) for s in CFG.arima_steps])).alias("step")
    return tidy(metrics.align(last.select(KEY, "yhat", steps), df, start + 1))


@query
def model_leaderboard(spark, d):
    """The two forecasters above ranked per group and step; a step that only one forecasts has one place."""
    steps = tuple(sorted({*CFG.steps, *CFG.arima_steps}))
    rows = _naive(spark, d).drop(DAY).unionByName(_mean_or_last(spark, d).drop("order"))
    scores = metrics.scores_by_group_and_total(rows, steps)
    return tidy(metrics.leaderboard(scores))


# --- Gram matrices and models ------------------------------------------------------------------------


@query
def ridge_gram(spark, d):
    series = ridge.ridge_series(filtered(spark, d))
    weeks = series_length(series, "y", CFG.ridge_train)
    sums = ridge.ridge_gram(series, weeks, CFG.ridge_train, ridge.CHUNKS)
    return tidy(sums)


@query
def var_gram(spark, d):
    series = var.var_series(filtered(spark, d), CFG)
    sums = var.var_gram(series, series_length(series, "x", CFG.var_lags + 1))
    return sums.withColumn("s", F.round("s", 4))


@query
def window_gram(spark, d):
    series = window.window_series(filtered(spark, d), CFG)
    sums = window.window_gram(series, series_length(series, "y", CFG.window + max(CFG.steps)), CFG)
    return sums.withColumn("s", F.round("s", 3))


@query
def adf_test(spark, d):
    return tidy(stationarity.adf_test(filtered(spark, d), CFG))


@query
def non_stationary_count(spark, d):
    """Train weeks before and after taking first differences."""
    df = features.last_split(filtered(spark, d), CFG.var_test).where("part = 'train'")
    changes = features.first_difference(df)
    before = stationarity.non_stationary_count(df, CFG).withColumn("of", F.lit("level"))
    after = stationarity.non_stationary_count(changes, CFG, f"diff_{QTY}").withColumn("of", F.lit("difference"))
    return before.unionByName(after)


@query
def arima_search(spark, d):
    return tidy(arima.search_forecast(filtered(spark, d), CFG))


@query
def ridge_grid(spark, d):
    return tidy(ridge.search_ridge(filtered(spark, d), CFG))


@query
def ridge_kkt(spark, d):
    """All fits of the grid: whether the conditions of an optimum hold within a billionth."""
    df = ridge.optimality(filtered(spark, d), CFG)
    return df.select("lags", "alpha", "covariates", "fit_intercept", "chunk", (F.col("violation") < 1e-9).alias("optimal"))


ONE_LAG = tuple(ridge.RidgeParams((1,), alpha, (), intercept, 1) for alpha in ridge.ALPHAS for intercept in (True, False))


@query
def ridge_grid_small(spark, d):
    """The grid search over models of one lag."""
    return tidy(ridge.search_ridge(filtered(spark, d), CFG, ONE_LAG))


@query
def ridge_one_lag(spark, d):
    """The best of them refitted, rolled forward over its own forecasts."""
    return tidy(ridge.forecast_ridge(filtered(spark, d), CFG, ONE_LAG))


@query
def forest_grid(spark, d):
    return tidy(forest.search_forest(filtered(spark, d), CFG))


# Forecasts are staged once, as the comparison of all models reads them again.
arima_rows = once(lambda spark, d: stage(arima.forecast_arima(filtered(spark, d), CFG), "arima"))
ridge_rows = once(lambda spark, d: stage(ridge.forecast_ridge(filtered(spark, d), CFG), "ridge"))
forest_rows = once(lambda spark, d: stage(forest.forecast_forest(filtered(spark, d), CFG), "forest"))
var_rows = once(lambda spark, d: stage(var.forecast_var(filtered(spark, d), CFG), "var"))
window_rows = once(lambda spark, d: stage(window.forecast_window(filtered(spark, d), CFG), "window"))


@query
def arima_forecast(spark, d):
    return tidy(arima_rows(spark, d))


@query
def ridge_lag_forecast(spark, d):
    return tidy(ridge_rows(spark, d))


@query
def random_forest_forecast(spark, d):
    return tidy(forest_rows(spark, d))


@query
def var_forecast(spark, d):
    return tidy(var_rows(spark, d))


@query
def window_forecast(spark, d):
    return tidy(window_rows(spark, d))


def _four_models(spark, d):
    rows = [f(spark, d) for f in (arima_rows, ridge_rows, var_rows, window_rows)]
    scoped = [r if "scope" in r.columns else r.withColumn("scope", F.lit("-")) for r in rows]
    keep = ["model", "scope", KEY, GROUP, "step", "y"]
    return reduce(DataFrame.unionByName, [r.select(keep) for r in scoped])


@query
def forecast_alignment(spark, d):
    """The actual values the forecasts are scored against, by model, scope and step."""
    return tidy(_four_models(spark, d))


@query
def forecast_coverage(spark, d):
    """How many forecasts every product has, by model and scope."""
    return _four_models(spark, d).groupBy("model", "scope", KEY).agg(F.count(F.lit(1)).alias("n_rows"))


# The same code with parameters small enough for SQL to solve in closed form.


@query
def window_one(spark, d):
    """One week predicts the next: a straight line per group and one over all."""
    return tidy(window.forecast_window(filtered(spark, d), replace(CFG, window=1, steps=(1,))).drop("target_week"))


@query
def var_single(spark, d):
    """Every product its own group, one lag."""
    alone = filtered(spark, d).withColumn(GROUP, F.col(KEY).cast("bigint"))
    return tidy(var.forecast_var(alone, replace(CFG, var_lags=1)).drop("target_week"))


@query
def arima_ar1(spark, d):
    """Constant or AR(1) by AICc, on the values (d = 0) and on their differences (d = 1)."""
    return tidy(_ar1(spark, d).drop("target_week"))


def _ar1(spark, d):
    small = replace(CFG, arima_max_p=1, arima_max_q=0)
    parts = [
        arima.search_forecast(filtered(spark, d), replace(small, adf_level=level)).withColumn("d", F.lit(order))
        for order, level in ((0, 2.0), (1, 0.0))
    ]
    return parts[0].unionByName(parts[1])


@query
def metrics_by_product_search(spark, d):
    """Scores of each searched product."""
    return tidy(metrics.score(_ar1(spark, d), [KEY, "d"]))


def _small_forest(spark, d, trees, depth, rule):
    made = forest.forecast_forest(filtered(spark, d), replace(CFG, forest_depth=depth), trees, rule=rule)
    # Means of halves end in a decimal tie now and then: nine decimals, not six.
    exact = {c: F.round(c, 9) + F.lit(0.0) for c in ("y", "yhat")}
    return made.drop("target_week").withColumn(DAY, F.col(DAY).cast("string")).withColumns(exact)


@query
def forest_stump(spark, d):
    """One tree with one cut for each group and one over all, every feature tried."""
    return _small_forest(spark, d, 1, 1, "all")


@query
def forest_small(spark, d):
    """Five trees of four levels, each node with its own choice of features."""
    return _small_forest(spark, d, 5, 4, "sqrt")


@query
def arima_order(spark, d):
    """Orders and criteria of the same search, of values and of differences, and how far every product was searched."""
    small = replace(CFG, arima_max_p=1, arima_max_q=0)
    parts = [arima.arima_orders(filtered(spark, d), replace(small, adf_level=level)) for level in (2.0, 0.0)]
    return tidy(parts[0].unionByName(parts[1]))


@query
def arima_order_search(spark, d):
    """The orders that the full search takes."""
    return tidy(arima.arima_orders(filtered(spark, d), CFG))


@query
def forest_alignment(spark, d):
    return tidy(forest_rows(spark, d).select("scope", KEY, GROUP, DAY, "step", "y"))


@query
def shared_leaderboard(spark, d):
    """Four small models ranked on the targets that all of them have forecast, from one week on."""
    df, fair = filtered(spark, d), evaluation.shared_origin(CFG)
    alone = df.withColumn(GROUP, F.col(KEY).cast("bigint"))
    single = var.forecast_var(alone, replace(fair, var_lags=1))
    forecasts = [
        naive.forecast_naive(df, fair),
        arima.mean_or_last_forecast(df, variation.dickey_fuller_lag0(df), fair),
        single.withColumn(GROUP, (F.col(KEY) % 10).cast("bigint")),  # the product's group is its last digit
        window.forecast_window(df, replace(fair, window=1)),
    ]
    return tidy(evaluation.compare_shared(forecasts, fair))


@query
def all_models_shared(spark, d):
    """All models ranked on shared targets."""
    df, fair = filtered(spark, d), evaluation.shared_origin(CFG)
    own = [arima.forecast_arima(df, fair), var.forecast_var(df, fair)]
    rest = [f(spark, d) for f in (ridge_rows, forest_rows, window_rows)]
    return tidy(evaluation.compare_shared([_naive(spark, d), *own, *rest], fair))


@query
def all_models_leaderboard(spark, d):
    rows = [f(spark, d) for f in (arima_rows, ridge_rows, forest_rows, var_rows, window_rows)]
    return tidy(evaluation.compare([_naive(spark, d), *rows], CFG))
