"""One ridge regression with non-negative coefficients on lagged values, pooled over products.

All fits of the parameter grid come from Gram matrices of one pass over the series: the widest
lag set and both covariates are summed once per chunk length, and every smaller model is a
sub-matrix. The fits themselves are a few numbers on the driver; scoring the whole grid is one
more pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weekloom.config import GROUP, KEY, QTY, ForecastConfig
from weekloom.operators.gram import SERIES_PER_STEP, gram, matrix, matrix_of, series_length
from weekloom.operators.series import series_arrays, week_at
from weekloom.session import stage

# The parameter grid.
LAG_SETS = ((1, 2, 3, 4, 12, 52), (1, 2, 3, 4, 12, 26, 52))
ALPHAS = (0.1, 0.2, 0.001)
COVARIATES = (("sales_year",), ("sales_week",), ("sales_year", "sales_week"))
INTERCEPTS = (True, False)
CHUNKS = (1, 2, 6, 12, 26)

ALL_LAGS = LAG_SETS[1]
ALL_COVARIATES = COVARIATES[2]


@dataclass(frozen=True)
class RidgeParams:
    lags: tuple[int, ...]
    alpha: float
    covariates: tuple[str, ...]
    intercept: bool
    chunk: int

    def __str__(self) -> str:
        lags, covariates = ",".join(map(str, self.lags)), ",".join(self.covariates)
        return f"lags={lags} alpha={self.alpha} covariates={covariates} intercept={self.intercept} chunk={self.chunk}"


GRID = tuple(RidgeParams(*p) for p in product(LAG_SETS, ALPHAS, COVARIATES, INTERCEPTS, CHUNKS))


@dataclass(frozen=True)
class RidgeModel:
    params: RidgeParams
    bias: np.ndarray  # one per step of the chunk
    weights: np.ndarray  # (lags and covariates) x chunk


def ridge_series(history: DataFrame) -> DataFrame:
    """Per product: weeks ``n``, values ``y``, and ``z`` = values, then years, then week numbers."""
    series = series_arrays(history, QTY, GROUP, also=ALL_COVARIATES)
    return series.select(KEY, GROUP, "n", "first_week", "y", F.concat("y", *ALL_COVARIATES).alias("z"))


def _design(weeks: int, train: int, chunk: int):
    """Rows (1, lags, covariates of the first target week, targets) of the first ``train`` weeks."""
    t = np.arange(max(ALL_LAGS), train - chunk + 1)

    def rows(z: np.ndarray) -> np.ndarray:
        cols = [np.ones((len(z), len(t)))]
        cols += [z[:, t - lag] for lag in ALL_LAGS]
        cols += [z[:, (i + 1) * weeks + t] for i in range(len(ALL_COVARIATES))]
        cols += [z[:, t + s] for s in range(chunk)]
        return np.stack(cols, axis=2).reshape(-1, len(cols))

    return rows


def ridge_gram(series: DataFrame, weeks: int, train: int, chunks: tuple[int, ...]) -> DataFrame:
    """(design = chunk, i, j, s) over all products; columns: 1, seven lags, year, week, targets."""
    return gram(series, "z", 3 * weeks, {c: _design(weeks, train, c) for c in chunks})


def non_negative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimise w'aw/2 - b'w over w >= 0 for positive definite ``a`` (active set, exact)."""
    k = len(b)
    w, free = np.zeros(k), np.zeros(k, dtype=bool)
    tol = 1e-10 * max(1.0, np.abs(b).max())
    for _ in range(10 * k):
        grad = b - a @ w
        if free.all() or grad[~free].max() <= tol:
            break
        free[np.flatnonzero(~free)[grad[~free].argmax()]] = True
        while True:
            trial = np.zeros(k)
            trial[free] = np.linalg.solve(a[np.ix_(free, free)], b[free])
            if trial[free].min() > 0:
                break
            bad = free & (trial <= 0)
            move = (w[bad] / (w[bad] - trial[bad])).min()
            w = w + move * (trial - w)
            free &= w > 1e-14
            if not free.any():
                trial = np.zeros(k)
                break
        w = trial
    else:
        raise ArithmeticError("non-negative least squares did not converge")
    return w


def _columns(params: RidgeParams) -> tuple[list[int], np.ndarray]:
    """Design columns of the regressors and of the targets."""
    x = [1 + ALL_LAGS.index(lag) for lag in params.lags]
    x += [1 + len(ALL_LAGS) + ALL_COVARIATES.index(c) for c in params.covariates]
    return x, 1 + len(ALL_LAGS) + len(ALL_COVARIATES) + np.arange(params.chunk)


def fit(m: np.ndarray, params: RidgeParams) -> RidgeModel:
    """Coefficients from the Gram matrix of the chunk; the intercept is not penalised."""
    x, y = _columns(params)
    n = m[0, 0]
    xx, xy = m[np.ix_(x, x)], m[np.ix_(x, y)]
    mx, my = m[0, x] / n, m[0, y] / n
    if params.intercept:
        xx, xy = xx - n * np.outer(mx, mx), xy - n * np.outer(mx, my)
    a = xx + params.alpha * np.eye(len(x))
    weights = np.column_stack([non_negative(a, xy[:, j]) for j in range(params.chunk)])
    bias = my - mx @ weights if params.intercept else np.zeros(params.chunk)
    return RidgeModel(params, bias, weights)


def roll_forward(model: RidgeModel, z: np.ndarray, weeks: int, start: int, steps: int) -> np.ndarray:
    """Forecast ``steps`` weeks after the first ``start`` ones, chunk by chunk on own forecasts.

    The last chunk ends exactly at the last step: it starts earlier when the steps are no multiple
    of the chunk, and only its new weeks are used.
    """
    p = model.params
    known = z[:, :start]
    done = 0
    while done < steps:
        first = done if done == 0 else min(done, steps - p.chunk)
        cols = [known[:, start + first - lag] for lag in p.lags]
        cols += [z[:, (1 + ALL_COVARIATES.index(c)) * weeks + start + first] for c in p.covariates]
        made = model.bias + np.stack(cols, axis=1) @ model.weights
        known = np.hstack([known, made[:, done - first :]])
        done = first + p.chunk
    return known[:, start : start + steps]


def _matrices(series: DataFrame, weeks: int, train: int, chunks: tuple[int, ...]) -> dict[int, np.ndarray]:
    """The Gram matrices as numpy arrays: at most 36 x 36 numbers per chunk length."""
    rows = ridge_gram(series, weeks, train, chunks).toPandas()
    return {int(c): matrix(part) for c, part in rows.groupby("design")}


def search_ridge(
    history: DataFrame, cfg: ForecastConfig, grid: tuple[RidgeParams, ...] = GRID
) -> DataFrame:
    """RMSE of every parameter set over the validation weeks, fitted on the train weeks, the ``best`` one marked."""
    series = stage(ridge_series(history), "ridge-series")
    scored = stage(_search(series, cfg, grid), "ridge-grid")
    best = scored.agg(F.min(F.struct("rmse", "id")).alias("m")).scalar()
    return scored.withColumn("best", F.col("id") == best["id"])


def optimality(history: DataFrame, cfg: ForecastConfig, grid: tuple[RidgeParams, ...] = GRID) -> DataFrame:
    """(parameters, positive, violation): how far the fits on the train weeks are from the conditions of an optimum.

    At the optimum no weight that is zero would lower the error by growing, and the error is flat in every
    positive one. The slopes come from a pass of their own over the series, as sums of regressor times
    residual, not from the Gram matrices the weights were solved from. ``violation`` is the worst slope relative to the
    largest product sum of regressor and target (without their means where an intercept is fitted).
    """
    series = stage(ridge_series(history), "ridge-series")
    train = cfg.ridge_train
    weeks = series_length(series, "y", train)
    chunks = tuple(sorted({p.chunk for p in grid}))
    sums = _matrices(series, weeks, train, chunks)
    models = [fit(sums[p.chunk], p) for p in grid]
    designs = {c: _design(weeks, train, c) for c in chunks}

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(m.weights) + 1, m.params.chunk)) for m in models]
        for batch in batches:
            z = matrix_of(batch.column("z"), 3 * weeks)
            for lo in range(0, len(z), SERIES_PER_STEP):
                rows = {c: design(z[lo : lo + SERIES_PER_STEP]) for c, design in designs.items()}
                for i, m in enumerate(models):
                    x, y = _columns(m.params)
                    own = rows[m.params.chunk]
                    residual = own[:, y] - m.bias - own[:, x] @ m.weights
                    total[i] += np.vstack([residual.sum(0)[None], own[:, x].T @ residual])
        for i, t in enumerate(total):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(t.size, i), pa.int32()), pa.array(np.arange(t.size), pa.int32()), pa.array(t.ravel())],
                names=["id", "cell", "s"],
            )

    # Some 12,000 numbers, whatever the number of series.
    found = (
        series.select("z")
        .mapInArrow(slopes, "id int, cell int, s double")
        .groupBy("id", "cell")
        .agg(F.sum("s").alias("s"))
        .toPandas()
        .sort_values(["id", "cell"])
    )
    parts = {i: part["s"].to_numpy() for i, part in found.groupby("id")}
    rated = []
    for i, m in enumerate(models):
        p = m.params
        slope = parts[i].reshape(-1, p.chunk) if i in parts else np.zeros((len(m.weights) + 1, p.chunk))
        flat, pull = slope[0], slope[1:] - p.alpha * m.weights
        x, y = _columns(p)
        g = sums[p.chunk]
        products = np.abs(g[np.ix_(x, y)] - (np.outer(g[0, x], g[0, y]) / g[0, 0] if p.intercept else 0)).max()
        worst = np.where(m.weights > 0, np.abs(pull), np.maximum(pull, 0.0)).max()
        if p.intercept:
            worst = max(worst, np.abs(flat).max())
        rated.append((int((m.weights > 0).sum()), float(worst / max(products, 1e-300))))
    params = _parameters(grid)
    params["positive"], params["violation"] = zip(*rated)
    return series.sparkSession.createDataFrame(params)


def _search(series: DataFrame, cfg: ForecastConfig, grid: tuple[RidgeParams, ...]) -> DataFrame:
    train, steps = cfg.ridge_train, cfg.ridge_valid
    weeks = series_length(series, "y", train + steps)
    sums = _matrices(series, weeks, train, tuple(sorted({p.chunk for p in grid})))
    models = [fit(sums[p.chunk], p) for p in grid]
    out = pa.schema([("id", pa.int32()), ("sse", pa.float64()), ("n", pa.int64())])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sse, n = np.zeros(len(models)), 0
        for batch in batches:
            z = matrix_of(batch.column("z"), 3 * weeks)
            for lo in range(0, len(z), SERIES_PER_STEP):
                block = z[lo : lo + SERIES_PER_STEP]
                actual = block[:, train : train + steps]
                for i, m in enumerate(models):
                    sse[i] += ((roll_forward(m, block, weeks, train, steps) - actual) ** 2).sum()
            n += len(z) * steps
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(models)), pa.int32()), pa.array(sse), pa.array(np.full(len(models), n))],
            schema=out,
        )

    params = _parameters(grid)
    total = series.select("z").mapInArrow(errors, "id int, sse double, n long").groupBy("id")
    scored = total.agg(F.sqrt(F.try_divide(F.sum("sse"), F.sum("n"))).alias("rmse"))
    # One row per parameter set, a fixed number.
    return F.broadcast(series.sparkSession.createDataFrame(params)).join(scored, "id")


def _parameters(grid: tuple[RidgeParams, ...]) -> pd.DataFrame:
    rows = [
        (i, ",".join(map(str, p.lags)), p.alpha, ",".join(p.covariates), p.intercept, p.chunk)
        for i, p in enumerate(grid)
    ]
    names = ["id", "lags", "alpha", "covariates", "fit_intercept", "chunk"]
    return pd.DataFrame(rows, columns=names).astype({"id": "int32", "chunk": "int32"})


def forecast_ridge(
    history: DataFrame, cfg: ForecastConfig, grid: tuple[RidgeParams, ...] = GRID
) -> DataFrame:
    """Best parameters of the grid, refitted on train and validation weeks, ``ridge_test`` steps; they stand in ``params``."""
    series = stage(ridge_series(history), "ridge-series")
    start, steps = cfg.ridge_train + cfg.ridge_valid, cfg.ridge_test
    weeks = series_length(series, "y", start + steps)
    best = grid[0] if len(grid) == 1 else grid[_search(series, cfg, grid).orderBy("rmse", "id").first()["id"]]
    model = fit(_matrices(series, weeks, start, (best.chunk,))[best.chunk], best)

    @pandas_udf("array<double>")
    def forecast(z: pd.Series) -> pd.Series:
        return pd.Series(list(roll_forward(model, np.stack(z.to_list()), weeks, start, steps)))

    made = series.select(KEY, GROUP, "first_week", "y", F.posexplode(forecast("z")).alias("p", "yhat"))
    return made.select(
        F.lit("ridge").alias("model"),
        KEY,
        GROUP,
        (F.col("p") + 1).alias("step"),
        week_at(F.lit(start) + F.col("p")),
        F.get("y", F.lit(start) + F.col("p")).alias("y"),
        "yhat",
        F.lit(str(best)).alias("params"),
    )
