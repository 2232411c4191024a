"""Encodings, lags, differences, rolling means, lead targets, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekloom.config import COUNTER, DAY, FLAG, GROUP, KEY, QTY, ForecastConfig
from weekloom.functions.encode import class_number, flag, yes_no
from weekloom.operators.series import product_weeks, series_arrays, whole

STATIC_FEATURES = [
    QTY,
    COUNTER,
    "sales_week",
    "sales_year",
    "sis_sub_family_id",
    GROUP,
    "vendor_id",
    "is_stock_numeric",
    "FR_numeric",
    "etim_class_numeric",
]


def encode_attributes(df: DataFrame) -> DataFrame:
    """Y/N, boolean and class code attributes as numbers."""
    return df.withColumns(
        {
            "is_stock_numeric": yes_no(F.col("is_stock")),
            "FR_numeric": flag(F.col(FLAG)),
            "etim_class_numeric": class_number(F.col("etim_class_id")),
        }
    )


def date_split(df: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """``split`` = 'train' before the split date, 'valid' from it on."""
    return df.withColumn("split", F.when(F.col(DAY) < F.lit(cfg.split_date), "train").otherwise("valid"))


def share_split(df: DataFrame, share: float) -> DataFrame:
    """First int(share x n) rows of each product are 'train', the rest 'test'; ``pos`` from 1."""
    w = product_weeks()
    cut = F.floor(F.count("*").over(whole(w)) * F.lit(share))
    return df.withColumn("pos", F.row_number().over(w)).withColumn(
        "part", F.when(F.col("pos") <= cut, "train").otherwise("test")
    )


def position_split(df: DataFrame, train: int, valid: int) -> DataFrame:
    """Rows 1..train, then ``valid`` rows, then 'test'."""
    pos = F.row_number().over(product_weeks())
    return df.withColumn("pos", pos).withColumn(
        "part",
        F.when(F.col("pos") <= train, "train").when(F.col("pos") <= train + valid, "valid").otherwise("test"),
    )


def last_split(df: DataFrame, test: int) -> DataFrame:
    """The last ``test`` rows of each product are 'test'."""
    w = product_weeks()
    left = F.count("*").over(whole(w)) - F.row_number().over(w)
    return df.withColumn("part", F.when(left < test, "test").otherwise("train"))


def lag_columns(w, col: str, lags: tuple[int, ...]) -> dict[str, Column]:
    """Value ``k`` rows back, and the difference to it."""
    return {f"lag_{col}_{k}": F.lag(col, k).over(w) for k in lags} | {
        f"diff_{col}_{k}": F.col(col) - F.lag(col, k).over(w) for k in lags
    }


def rolling_columns(w, col: str, sizes: tuple[int, ...]) -> dict[str, Column]:
    """Mean of the ``k`` newest rows including the current one; null until ``k`` rows exist."""
    out = {}
    for k in sizes:
        frame = w.rowsBetween(-(k - 1), Window.currentRow)
        out[f"mean_tqs_{k}"] = F.when(F.count(col).over(frame) == k, F.avg(col).over(frame))
    return out


def lead_columns(w, col: str, steps: tuple[int, ...]) -> dict[str, Column]:
    return {f"{col}_next_week_{k}": F.lead(col, k).over(w) for k in steps}


def lag_features(df: DataFrame, lags: tuple[int, ...], *within: str, col: str = QTY) -> DataFrame:
    return df.withColumns(lag_columns(product_weeks(*within), col, lags))


def rolling_mean(df: DataFrame, sizes: tuple[int, ...], *within: str, col: str = QTY) -> DataFrame:
    return df.withColumns(rolling_columns(product_weeks(*within), col, sizes))


def lead_targets(df: DataFrame, steps: tuple[int, ...], *within: str, col: str = QTY) -> DataFrame:
    return df.withColumns(lead_columns(product_weeks(*within), col, steps))


def first_difference(df: DataFrame, col: str = QTY) -> DataFrame:
    """x minus the previous x; the first row of a product is dropped."""
    diff = df.withColumn(f"diff_{col}", F.col(col) - F.lag(col).over(product_weeks()))
    return diff.where(F.col(f"diff_{col}").isNotNull())


def invert_difference(changes: DataFrame, last_train: DataFrame, col: str = "yhat") -> DataFrame:
    """Levels from forecast changes: last known value plus the running sum over the steps.

    ``changes`` has (product_id, step, col), ``last_train`` has (product_id, last_value).
    """
    w = Window.partitionBy(KEY).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = changes.join(last_train, KEY)
    return joined.withColumn(col, F.col("last_value") + F.sum(col).over(w)).drop("last_value")


def _known(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def one_step_features(df: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Encodings, next week's quantity, and lag 1, difference 1 and mean of 4 within each split.

    Train rows with any null are dropped before the lags are taken; lags never cross the split.
    """
    base = date_split(encode_attributes(df), cfg)
    w = product_weeks("split")
    base = base.withColumn("total_qty_next_week", F.lead(QTY).over(w))
    kept = base.where((F.col("split") == "valid") | _known([*STATIC_FEATURES, "total_qty_next_week"]))
    made = lag_columns(w, QTY, (1,)) | rolling_columns(w, QTY, (4,))
    return kept.withColumns(made).select(
        KEY, DAY, "split", *STATIC_FEATURES, *[c for c in made], "total_qty_next_week"
    )


def multi_step_names(cfg: ForecastConfig) -> tuple[list[str], list[str]]:
    """Feature and target columns of ``multi_step_features``."""
    made = [f"lag_{QTY}_{k}" for k in cfg.steps] + [f"diff_{QTY}_{k}" for k in cfg.steps]
    made += [f"mean_tqs_{k}" for k in cfg.steps[-3:]]
    return [*STATIC_FEATURES, *made], [f"{QTY}_next_week_{k}" for k in cfg.steps]


def multi_step_features(df: DataFrame, cfg: ForecastConfig, *keep: str) -> DataFrame:
    """Lags, differences, rolling means and one target per step, within each split.

    Train rows need every lag, and since each target is taken on the frame the previous one has
    already trimmed, the last 1 + 2 + ... (sum of the steps) rows of a product go too. Validation
    rows are all kept. One sort serves every window, as they share the partitioning and order.
    Columns named in ``keep`` stay too.
    """
    features, targets = multi_step_names(cfg)
    w = product_weeks("split")
    made = lag_columns(w, QTY, cfg.steps) | rolling_columns(w, QTY, cfg.steps[-3:])
    base = date_split(encode_attributes(df), cfg).withColumns(made)
    kept = base.where((F.col("split") == "valid") | _known(features))
    left = F.count("*").over(whole(w)) - F.row_number().over(w)
    ready = kept.withColumns(lead_columns(w, QTY, cfg.steps) | {"_left": left})
    ready = ready.where((F.col("split") == "valid") | (F.col("_left") >= sum(cfg.steps)))
    return ready.select(KEY, DAY, "split", *features, *targets, *keep)


def window_samples(df: DataFrame, cfg: ForecastConfig, col: str = QTY) -> DataFrame:
    """One row per product and start i: ``window`` inputs and the values ``step`` weeks after them."""
    series = series_arrays(df, col).where(F.col("n") >= cfg.window + max(cfg.steps))
    cut = F.transform(
        F.sequence(F.lit(0), F.col("n") - cfg.window - max(cfg.steps)),
        lambda i: F.struct(
            i.alias("i"),
            F.slice("y", i + 1, cfg.window).alias("x"),
            F.array(*[F.get("y", i + cfg.window + s - 1) for s in cfg.steps]).alias("target"),
        ),
    )
    return series.select(KEY, F.inline(cut))
