"""RMSE and WMAPE of long forecast rows, score tables, ranking of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekloom.config import DAY, GROUP, KEY, QTY
from weekloom.operators.series import product_weeks


def score(forecast: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE, WMAPE = sum|y - yhat| / sum|y| and row count per ``keys`` (empty for one total row).

    ``forecast`` has y and yhat. Rows without an actual value do not count.
    """
    err = F.col("y") - F.col("yhat")
    return (
        forecast.where(F.col("y").isNotNull() & F.col("yhat").isNotNull())
        .groupBy(*keys)
        .agg(
            F.sqrt(F.avg(err * err)).alias("rmse"),
            F.try_divide(F.sum(F.abs(err)), F.sum(F.abs("y"))).alias("wmape"),
            F.count("*").alias("n"),
        )
    )


def scores_by_group_and_total(forecast: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """(model, grp, step, rmse, wmape, n) at the given steps: one row per group, and ``total``.

    Where a ``scope`` tells group models from one over all products, groups are scored on the
    former and the total on the latter; otherwise the total is over the same rows. Grouping sets
    give both levels in one aggregation.
    """
    err = F.col("y") - F.col("yhat")
    known = forecast.where(F.col("step").isin(*steps) & F.col("y").isNotNull() & F.col("yhat").isNotNull())
    if "scope" not in known.columns:
        known = known.withColumn("scope", F.lit("both"))
    keys = ["model", "scope", GROUP, "step"]
    scored = known.groupingSets([keys, ["model", "scope", "step"]], *keys).agg(
        F.grouping(GROUP).alias("is_total"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.try_divide(F.sum(F.abs(err)), F.sum(F.abs("y"))).alias("wmape"),
        F.count("*").alias("n"),
    )
    wanted = F.when(F.col("is_total") == 1, "total").otherwise("group")
    return scored.where((F.col("scope") == "both") | (F.col("scope") == wanted)).select(
        "model",
        F.when(F.col("is_total") == 1, "total").otherwise(F.col(GROUP).cast("string")).alias("grp"),
        "step",
        "rmse",
        "wmape",
        "n",
    )


def shared_targets(forecast: DataFrame, models: int) -> DataFrame:
    """Rows of the cells (product, target week, step) that all ``models`` have forecast.

    One shuffle by cell, whatever the number of models; a cell holds a row per model and scope.
    """
    known = forecast.where(F.col("y").isNotNull() & F.col("yhat").isNotNull())
    if "scope" not in known.columns:
        known = known.withColumn("scope", F.lit("both"))
    rows = F.collect_list(F.struct("model", "scope", GROUP, "y", "yhat"))
    cells = known.groupBy(KEY, "target_week", "step").agg(rows.alias("rows"))
    shared = cells.where(F.size(F.array_distinct("rows.model")) == models)
    return shared.select(KEY, "target_week", "step", F.inline("rows"))


def align(forecast: DataFrame, actual: DataFrame, first_pos: int) -> DataFrame:
    """Join forecasts (product_id, step, yhat) with the actual value at position first_pos + step - 1."""
    pos = F.row_number().over(product_weeks())
    test = actual.select(KEY, GROUP, F.col(QTY).alias("y"), (pos - first_pos + 1).alias("step"))
    return forecast.join(test.where("step >= 1"), [KEY, "step"]).select(KEY, GROUP, "step", "y", "yhat")


def trim_last_steps(df: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """Long (product, week, step, y): rows whose week still has a value ``step`` weeks later."""
    w = product_weeks()
    ahead = df.select(KEY, GROUP, DAY, QTY, *[F.lead(QTY, s).over(w).alias(f"_{s}") for s in steps])
    rows = F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"_{s}").alias("y")) for s in steps])
    return ahead.select(KEY, GROUP, DAY, QTY, F.inline(rows)).where(F.col("y").isNotNull())


def step_group_table(scores: DataFrame, metric: str, groups: list[str] | None = None) -> DataFrame:
    """One row per step labelled ``step_k``, one column per group and ``total``."""
    pivoted = scores.groupBy("step").pivot("grp", groups).agg(F.first(metric))
    return pivoted.withColumn("step", F.concat(F.lit("step_"), F.col("step").cast("string")))


def leaderboard(scores: DataFrame) -> DataFrame:
    """Rank of every model per group and step, lowest RMSE first."""
    w = Window.partitionBy("grp", "step").orderBy("rmse")
    return scores.withColumn("place", F.rank().over(w))
