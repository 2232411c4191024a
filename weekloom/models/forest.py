"""Random forests on the lag features: one for each product group, all steps together, and one over all products."""

from __future__ import annotations

from itertools import product
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.config import DAY, GROUP, KEY, QTY, ForecastConfig
from weekloom.models import trees as histogram
from weekloom.operators.features import STATIC_FEATURES, multi_step_features, multi_step_names, one_step_features
from weekloom.operators.scaling import scale
from weekloom.operators.series import weeks_after
from weekloom.session import stage, stage_all

TREES = 100
# The searched tree counts and feature rules.
GRID = tuple(product((100, 133, 166, 200), ("all", "sqrt")))
#: Group of the forest over all products.
ALL = "total"


def _shape(features: list[str], targets: int, trees: int, rule: str, cfg: ForecastConfig) -> histogram.Shape:
    tried = len(features) if rule == "all" else isqrt(len(features))
    return histogram.Shape(trees, cfg.forest_depth, cfg.forest_bins, len(features), targets, tried)


def forecast_forest(
    history: DataFrame, cfg: ForecastConfig, trees: int = TREES, scopes=("group", "total"), rule: str = "sqrt"
) -> DataFrame:
    """From every validation week: forecasts by the forest of the product's group (``scope``
    'group') and by the one over all products ('total'), back in original units.

    The forests of all groups and of both scopes grow together, and a tree has all steps as targets.
    """
    features, targets = multi_step_names(cfg)
    fit_rows = F.col(DAY) < F.lit(cfg.split_date) if cfg.scale_fit_on == "train" else None
    frames = []
    for scope in scopes:
        scaled = scale(history, QTY, GROUP if scope == "group" else None, fit_rows)
        made = multi_step_features(scaled, cfg, "mu", "sd")
        name = F.col(GROUP).cast("string") if scope == "group" else F.lit(ALL)
        frames.append(made.withColumn("g", F.concat_ws("/", F.lit(scope), name)).withColumn("scope", F.lit(scope)))
    frame = frames[0].unionByName(frames[1]) if len(frames) > 1 else frames[0]
    frame = stage(frame.withColumn("row", histogram.row_number(F.col(KEY), F.col(DAY))), "forest")
    keep = ["scope", KEY, GROUP, DAY, "mu", "sd", *targets]
    shape = _shape(features, len(targets), trees, rule, cfg)
    made = histogram.forecast(frame, features, targets, shape, (trees,), keep)
    return stage_all((_long(rows, cfg) for rows in made), "forest-forecast")


def _long(predicted: DataFrame, cfg: ForecastConfig) -> DataFrame:
    cells = [
        F.struct(
            F.lit(s).alias("step"),
            (F.col(f"{QTY}_next_week_{s}") * F.col("sd") + F.col("mu")).alias("y"),
            (F.col("p")[i] * F.col("sd") + F.col("mu")).alias("yhat"),
        )
        for i, s in enumerate(cfg.steps)
    ]
    rows = predicted.select(F.lit("forest").alias("model"), "scope", KEY, GROUP, DAY, F.inline(F.array(*cells)))
    return rows.where(F.col("y").isNotNull()).withColumn("target_week", weeks_after(F.col("step")))


def search_forest(
    history: DataFrame, cfg: ForecastConfig, grid: tuple[tuple[int, str], ...] = GRID
) -> DataFrame:
    """(trees, features, rmse, best): one-step forests scored on the validation weeks.

    A forest of fewer trees is the beginning of a larger one, so each feature rule grows once, and its
    predictions after every searched number of trees are scored in the same pass.
    """
    label = "total_qty_next_week"
    features = [*STATIC_FEATURES, f"lag_{QTY}_1", f"diff_{QTY}_1", "mean_tqs_4"]
    made = one_step_features(history, cfg).withColumn("g", F.lit(ALL))
    frame = stage(made.withColumn("row", histogram.row_number(F.col(KEY), F.col(DAY))), "forest-one-step")
    scores = []
    for rule in dict.fromkeys(r for _, r in grid):
        counts = tuple(sorted(t for t, r in grid if r == rule))
        shape = _shape(features, 1, max(counts), rule, cfg)
        cells = F.array(*[F.struct(F.lit(c).alias("trees"), F.col("p")[i].alias("yhat")) for i, c in enumerate(counts)])
        for rows in histogram.forecast(frame, features, [label], shape, counts, [label]):
            scores.append(rows.select(F.lit(rule).alias("features"), F.col(label).alias("y"), F.inline(cells)))
    rows = stage_all(scores, "forest-grid")
    error = F.col("y") - F.col("yhat")
    rmse = rows.where(F.col("y").isNotNull()).groupBy("trees", "features").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    rmse = stage(rmse, "forest-scores")
    first = rmse.agg(F.min(F.struct("rmse", "trees", "features")).alias("m")).scalar()
    return rmse.select(
        "trees",
        "features",
        "rmse",
        ((F.col("trees") == first["trees"]) & (F.col("features") == first["features"])).alias("best"),
    )
