import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from frames import demand, values
from pyspark.sql import functions as F

from weekloom.config import GROUP, KEY, QTY, ForecastConfig
from weekloom.models.arima import _stable, arma_forecast, arma_search, forecast_arima
from weekloom.models.forest import forecast_forest, search_forest
from weekloom.models import trees
from weekloom.models.naive import forecast_naive
from weekloom.models.ridge import (
    ALL_LAGS,
    GRID,
    RidgeModel,
    RidgeParams,
    fit,
    forecast_ridge,
    non_negative,
    optimality,
    ridge_gram,
    ridge_series,
    roll_forward,
    search_ridge,
)
from weekloom.models.stationarity import adf_block, adf_test, p_value
from weekloom.models.var import forecast_var, forecast_weights
from weekloom.models.window import forecast_window
from weekloom.operators.features import invert_difference, multi_step_features, one_step_features, share_split
from weekloom.operators.gram import gram, matrix
from weekloom.operators.metrics import leaderboard, score, scores_by_group_and_total, step_group_table
from weekloom.operators.scaling import impute_mean, scale, unscale
from weekloom.operators.series import series_arrays
from weekloom.operators.variation import demand_cov, dickey_fuller_lag0
from weekloom.session import join_small, stage, stage_all

WEEKS = 158
CFG = ForecastConfig(split_date=dt.date(2020, 1, 6) + dt.timedelta(days=7 * 106))


def history(spark, products=5, seed=1, group=lambda p: p % 2):
    rng = np.random.default_rng(seed)
    cells, series = [], {}
    for p in range(1, products + 1):
        y = np.round(20 + 8 * np.sin(np.arange(WEEKS) / 8 + p) + rng.normal(0, 2, WEEKS), 2)
        series[p] = y
        cells += [(p, w, v) for w, v in enumerate(y)]
    df = demand(spark, cells).withColumn("Forte_rotation", F.lit(True))
    expr = F.create_map(*[F.lit(x) for p in series for x in (p, group(p))])
    return df.withColumn(GROUP, expr[F.col(KEY).cast("int")].cast("bigint")), series


@pytest.fixture(scope="module")
def data(spark):
    df, series = history(spark)
    return df.persist(), series


# --- unit root test ------------------------------------------------------------------------------------


def plain_adf(x):
    """Straightforward version: one least squares per lag order."""
    n = len(x)
    most = int(np.ceil(12 * (n / 100) ** 0.25))
    dx = np.diff(x)

    def ols(lags, start):
        t = np.arange(start, n - 1)
        z = np.column_stack([np.ones(len(t)), x[t]] + [dx[t - k] for k in range(1, lags + 1)])
        b, *_ = np.linalg.lstsq(z, dx[t], rcond=None)
        r = dx[t] - z @ b
        return z, b, r

    aic = []
    for lags in range(most + 1):
        z, _, r = ols(lags, most)
        aic.append(len(r) * np.log(r @ r / len(r)) + 2 * z.shape[1])
    lags = int(np.argmin(aic))
    z, b, r = ols(lags, lags)
    s2 = r @ r / (len(r) - z.shape[1])
    return b[1] / np.sqrt(s2 * np.linalg.inv(z.T @ z)[1, 1]), lags


def test_adf_equals_plain_least_squares():
    rng = np.random.default_rng(3)
    noise = rng.normal(size=(4, WEEKS))
    walk = rng.normal(size=(4, WEEKS)).cumsum(axis=1)
    x = np.vstack([noise, walk, np.full((1, WEEKS), 2.0)])
    stat, lags = adf_block(x)
    for i in range(8):
        want, lag = plain_adf(x[i])
        assert lags[i] == lag
        assert stat[i] == pytest.approx(want, rel=1e-8)
    assert np.isnan(stat[8])


def test_p_values_at_known_critical_values():
    # asymptotic 1 %, 5 % and 10 % points of the statistic with constant
    got = p_value(np.array([-3.43, -2.86, -2.57, 5.0, -30.0]))
    assert got[:3] == pytest.approx([0.01, 0.05, 0.10], abs=2e-3)
    assert list(got[3:]) == [1.0, 0.0]


def test_difference_orders(spark):
    rng = np.random.default_rng(5)
    noise, walk = rng.normal(50, 5, WEEKS), 500 + rng.normal(0, 5, WEEKS).cumsum()
    cells = [(1, w, v) for w, v in enumerate(noise)] + [(2, w, v) for w, v in enumerate(walk)]
    cells += [(3, w, 7) for w in range(WEEKS)]
    df = demand(spark, cells)
    assert {r[KEY]: r["d"] for r in adf_test(df, CFG).collect()} == {1: 0, 2: 1, 3: 1}
    lag0 = {r[KEY]: r for r in dickey_fuller_lag0(df).collect()}
    assert {p: r["d"] for p, r in lag0.items()} == {1: 0, 2: 1, 3: 1}
    x, dx = noise[:-1], np.diff(noise)
    z = np.column_stack([np.ones(len(x)), x])
    b, *_ = np.linalg.lstsq(z, dx, rcond=None)
    r = dx - z @ b
    want = b[1] / np.sqrt(r @ r / (len(x) - 2) * np.linalg.inv(z.T @ z)[1, 1])
    assert lag0[1]["stat"] == pytest.approx(want, rel=1e-8)


# --- ARIMA ------------------------------------------------------------------------------------------------


def test_arma_finds_an_autoregression():
    rng = np.random.default_rng(11)
    x = np.zeros((3, 400))
    for t in range(1, 400):
        x[:, t] = 5 + 0.8 * x[:, t - 1] + rng.normal(0, 0.5, 3)
    made = arma_forecast(x, 24, arma_search(x))
    want = x[:, -1:].copy()
    for h in range(24):
        want = 5 + 0.8 * want
        assert made[:, h] == pytest.approx(want[:, 0], rel=0.08)
    level = np.full((2, 60), 4.0)
    assert arma_forecast(level, 5, arma_search(level)) == pytest.approx(np.full((2, 5), 4.0))
    assert arma_search(rng.normal(size=(2, 18))) is None  # the rows left do not carry a constant
    short = rng.normal(size=(2, 20))
    found = arma_search(short)  # five rows left: only orders of one coefficient have a criterion
    assert np.isfinite(arma_forecast(short, 5, found)).all() and (found.p + found.q <= 1).all()


def plain_arma11(x, long=10):
    """The three stages for one series and order (1, 1), written out; the criterion on rows after long + 1."""
    n = len(x)
    z = np.array([[1.0, *x[t - long : t][::-1]] for t in range(long, n)])
    e = np.concatenate([np.zeros(long), x[long:] - z @ np.linalg.lstsq(z, x[long:], rcond=None)[0]])
    rows = range(long + 1, n)
    z = np.array([[1.0, x[t - 1], e[t - 1]] for t in rows])
    w = np.linalg.lstsq(z, x[long + 1 :], rcond=None)[0]

    def errors(w):
        out = np.zeros(n)
        for t in range(1, n):
            out[t] = x[t] - w[0] - w[1] * x[t - 1] - w[2] * out[t - 1]
        return out

    e = errors(w)
    one, level, shock = np.zeros(n), np.zeros(n), np.zeros(n)
    level[0] = x[0]
    for t in range(1, n):
        one[t] = 1 - w[2] * one[t - 1]
        level[t] = x[t] - w[2] * level[t - 1]
        shock[t] = e[t] - w[2] * shock[t - 1]
    z = np.array([[one[t], level[t - 1], shock[t - 1]] for t in rows])
    w = w + np.linalg.lstsq(z, e[long + 1 :], rcond=None)[0]
    m, rss = len(rows), (errors(w)[long + 1 :] ** 2).sum()
    return w, m * np.log(rss / m) + m * (m + 3) / (m - 5), errors(w)


def test_arma_11_equals_plain_stages_and_truth():
    rng = np.random.default_rng(5)
    e = rng.normal(size=(4, 601))
    x = np.zeros((4, 601))
    for t in range(1, 601):
        x[:, t] = 2 + 0.6 * x[:, t - 1] + e[:, t] + 0.5 * e[:, t - 1]
    x = x[:, 1:]
    found = arma_search(x, 1, 1)
    assert (found.p == 1).all() and (found.q == 1).all()
    for i in range(4):
        w, aicc, shocks = plain_arma11(x[i])
        assert (found.const[i], found.ar[i, 0], found.ma[i, 0]) == pytest.approx(tuple(w), rel=1e-6)
        assert found.aicc[i] == pytest.approx(aicc, rel=1e-9)
        assert w[1:] == pytest.approx([0.6, 0.5], abs=0.13)
        step = arma_forecast(x, 2, found)[i]
        first = w[0] + w[1] * x[i, -1] + w[2] * shocks[-1]
        assert step == pytest.approx([first, w[0] + w[1] * first], rel=1e-6)


def test_stability_equals_roots():
    rng = np.random.default_rng(8)
    for p in range(6):
        w = rng.normal(0, 0.6, (400, p))
        want = [bool(not p or np.abs(np.roots([1.0, *-row])).max() < 0.999) for row in w]
        assert _stable(w).tolist() == want


def test_untested_order_is_null(spark):
    rows = adf_test(demand(spark, [(1, w, w % 3) for w in range(7)] + [(2, w, 5) for w in range(20)]), CFG).collect()
    assert {r[KEY]: (r["d"], r["n_lags"] is None) for r in rows} == {1: (None, True), 2: (1, False)}


def test_arima_keeps_short_products(spark):
    rng = np.random.default_rng(3)
    sizes = {1: 3, 2: 9, 3: 30, 4: 158}
    cells = [(p, w, 50 + rng.random()) for p, n in sizes.items() for w in range(n)]
    rows = forecast_arima(demand(spark, cells), CFG).collect()
    per_product = {p: sum(r["product_id"] == p for r in rows) for p in sizes}
    assert per_product == dict.fromkeys(sizes, CFG.arima_horizon)
    assert all(r["yhat"] is not None for r in rows)
    assert {r["order"] for r in rows if r["product_id"] == 1} == {"0,-,0"}


def test_arima_by_class(spark):
    spiky = [0.0] * WEEKS
    spiky[::20] = [100.0] * len(spiky[::20])
    steady = 30 + np.random.default_rng(2).normal(0, 3, WEEKS)
    cells = [(1, w, v) for w, v in enumerate(spiky)] + [(2, w, v) for w, v in enumerate(steady)]
    cells += [(3, w, 0) for w in range(WEEKS)]
    df = demand(spark, cells)
    assert {r[KEY]: r["cov_class"] for r in demand_cov(df, CFG).collect()} == {1: "high", 2: "low", 3: None}
    rows = forecast_arima(df, CFG).collect()
    assert {r[KEY] for r in rows} == {1, 2}  # no demand at all: in neither class
    mean = np.mean(spiky[:134])
    assert {round(r["yhat"], 9) for r in rows if r[KEY] == 1} == {round(mean, 9)}
    assert [r["step"] for r in rows if r[KEY] == 2] == list(range(1, 25))
    assert all(abs(r["yhat"] - 30) < 6 for r in rows if r[KEY] == 2)
    assert {r["y"] for r in rows if r[KEY] == 1 and r["step"] == 7} == {spiky[134 + 6]}


# --- Gram matrices, ridge ---------------------------------------------------------------------------------


def test_gram_by_key(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6))
    key = np.where(np.arange(600) % 3 == 0, 1, 2)
    df = spark.createDataFrame([(int(k), [float(a) for a in v]) for k, v in zip(key, x)], "k long, v array<double>")
    got = gram(df.repartition(5), "v", 6, {0: lambda b: b, 7: lambda b: b[:, :2]}, "k").toPandas()
    for (k, d), rows in got.groupby(["k", "design"]):
        z = x[key == k][:, : 6 if d == 0 else 2]
        assert matrix(rows) == pytest.approx(z.T @ z)
    with pytest.raises(Exception, match="complete the weekly grid"):
        gram(df, "v", 5, {0: lambda b: b}).collect()


def test_non_negative_solution_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(50):
        z = rng.normal(size=(40, 9))
        a, b = z.T @ z + 0.1 * np.eye(9), z.T @ rng.normal(size=40) * 3
        w = non_negative(a, b)
        grad = a @ w - b
        assert (w >= 0).all() and (grad > -1e-7).all() and np.abs(grad * w).max() < 1e-7


def test_ridge_gram_and_fit_equal_dense(spark, data):
    df, series = data
    params = RidgeParams((1, 2, 3, 4, 12, 52), 0.2, ("sales_week",), True, 6)
    packed = ridge_series(df)
    m = matrix(ridge_gram(packed, WEEKS, 100, (6,)).toPandas())
    week = values(df, "sales_week")
    rows, targets = [], []
    for p, y in series.items():
        for t in range(52, 95):
            rows.append([y[t - lag] for lag in params.lags] + [week[p, t]])
            targets.append(y[t : t + 6])
    x, y = np.array(rows), np.array(targets)
    assert m[0, 0] == len(x)
    model = fit(m, params)
    xc, yc = x - x.mean(0), y - y.mean(0)
    for j in range(6):
        w = model.weights[:, j]
        grad = xc.T @ (xc @ w - yc[:, j]) + 0.2 * w
        assert (w >= 0).all() and np.abs(grad[w > 0]).max() < 1e-5 and grad[w == 0].min(initial=0) > -1e-5
        assert model.bias[j] == pytest.approx(y[:, j].mean() - x.mean(0) @ w)


def test_ridge_optimality_notices_wrong_weights(spark, data, monkeypatch):
    df, _ = data
    grid = GRID[::23]
    good = optimality(df, CFG, grid).collect()
    assert len(good) == len(grid) and all(r["violation"] < 1e-9 for r in good)
    assert all(0 < r["positive"] <= (len(p.lags) + len(p.covariates)) * p.chunk for r, p in zip(good, grid))

    def shifted(m, params):
        model = fit(m, params)
        return RidgeModel(params, model.bias, model.weights * 1.01)

    monkeypatch.setattr("weekloom.models.ridge.fit", shifted)
    assert all(r["violation"] > 1e-6 for r in optimality(df, CFG, grid).collect())


def test_roll_forward_ends_exactly_at_the_last_step():
    params = RidgeParams((1, 2), 0.1, ("sales_week",), False, 3)
    # output j = previous value + (j + 1): makes the origin of each chunk visible
    model = RidgeModel(params, np.array([1.0, 2.0, 3.0]), np.array([[1.0] * 3, [0.0] * 3, [0.0] * 3]))
    z = np.concatenate([np.full((1, 10), 5.0), np.zeros((1, 20))], axis=1)
    assert roll_forward(model, z, 10, 4, 3)[0].tolist() == [6, 7, 8]
    assert roll_forward(model, z, 10, 4, 6)[0].tolist() == [6, 7, 8, 9, 10, 11]
    # five steps: the second chunk starts at step 2 (after value 7) and gives steps 3..5, of which 4, 5 are new
    assert roll_forward(model, z, 10, 4, 5)[0].tolist() == [6, 7, 8, 9, 10]


def test_ridge_search_scores_and_best_forecast(spark, data):
    df, series = data
    grid = GRID[::17]
    scores = {r["id"]: r for r in search_ridge(df, CFG, grid).collect()}
    assert len(scores) == len(grid) and len(GRID) == 180
    packed = ridge_series(df).collect()
    z = np.array([r["z"] for r in packed])
    for i in (0, len(grid) - 1):
        m = matrix(ridge_gram(ridge_series(df), WEEKS, 100, (grid[i].chunk,)).toPandas())
        made = roll_forward(fit(m, grid[i]), z, WEEKS, 100, 32)
        assert scores[i]["rmse"] == pytest.approx(np.sqrt(((made - z[:, 100:132]) ** 2).mean()))
    rows = forecast_ridge(df, CFG, grid).collect()
    assert len(rows) == 5 * 26
    assert {r["y"] for r in rows if r[KEY] == 2 and r["step"] == 26} == {series[2][157]}
    assert max(ALL_LAGS) == 52


# --- vector autoregression, windows -----------------------------------------------------------------------


@pytest.mark.parametrize("products", [2, 30])
def test_var_weights_equal_dense_least_squares(products):
    rng = np.random.default_rng(products)
    x = rng.normal(size=(60, products))
    lags, steps = 4, 12
    z = np.array([np.concatenate([[1.0], *[x[t - k] for k in range(1, lags + 1)]]) for t in range(lags, 60)])
    b = np.linalg.pinv(z, rcond=1e-10) @ x[lags:]
    past = list(x)
    for _ in range(steps):
        past.append(np.concatenate([[1.0], *[past[-k] for k in range(1, lags + 1)]]) @ b)
    want = np.cumsum(np.array(past[60:]), axis=0)
    got = forecast_weights(x @ x.T, lags, steps) @ x
    assert got == pytest.approx(want, abs=1e-8)


def test_var_forecast_undoes_difference_and_scaling(spark, data):
    df, series = data
    rows = forecast_var(df, CFG).collect()
    assert len(rows) == 5 * 30
    members = [p for p in series if p % 2 == 1]
    y = np.array([series[p] for p in members]).T
    mu, sd = y.mean(0), y.std(0)
    s = (y - mu) / sd
    x = np.diff(s[:-30], axis=0)
    made = (s[-31] + forecast_weights(x @ x.T, 10, 30) @ x) * sd + mu
    got = {(r[KEY], r["step"]): r["yhat"] for r in rows}
    for i, p in enumerate(members):
        assert [got[p, h + 1] for h in range(30)] == pytest.approx(made[:, i].tolist(), abs=1e-6)


def test_window_forecast_equals_dense(spark, data):
    df, series = data
    rows = forecast_window(df, CFG).collect()
    assert len(rows) == 2 * 5 * 6
    y = np.array([series[p] for p in series])
    mu, sd = y.mean(1, keepdims=True), y.std(1, keepdims=True)
    s = (y - mu) / sd
    steps = np.array(CFG.steps)
    for scope, members in (("total", list(series)), ("group", [2, 4])):
        idx = [list(series).index(p) for p in members]
        x, t = [], []
        for i in idx:
            for w in range(70):
                x.append(np.concatenate([[1.0], s[i, w : w + 50]]))
                t.append(s[i, w + 50 + steps - 1])
        b = np.linalg.pinv(np.array(x), rcond=1e-10) @ np.array(t)
        got = {(r[KEY], r["step"]): r for r in rows if r["scope"] == scope}
        for i, p in zip(idx, members):
            made = np.concatenate([[1.0], s[i, 82:132]]) @ b * sd[i] + mu[i]
            for j, h in enumerate(CFG.steps):
                assert got[p, h]["yhat"] == pytest.approx(max(made[j], 0), abs=1e-4)
                assert got[p, h]["y"] == pytest.approx(series[p][131 + h])


def test_short_or_uneven_series_are_refused(spark):
    df = demand(spark, [(1, w, 1 + w % 3) for w in range(60)])
    for forecast in (forecast_ridge, forecast_window, forecast_var):
        with pytest.raises(ValueError, match="too few"):
            forecast(df.limit(30), CFG)


# --- forest -----------------------------------------------------------------------------------------------


def test_forest_rows_and_search(spark, data):
    df, series = data
    rows = forecast_forest(df, replace(CFG, forest_depth=6), trees=5)
    by = {(r["scope"], r["step"]): r["count"] for r in rows.groupBy("scope", "step").count().collect()}
    assert by == {(s, h): 5 * (52 - h) for s in ("group", "total") for h in CFG.steps}
    worst = rows.agg(F.max(F.abs(F.col("y") - F.col("yhat")))).first()[0]
    assert worst < 25
    actual = rows.where((F.col(KEY) == 3) & (F.col("step") == 4)).orderBy("First_day").first()
    assert actual["y"] == pytest.approx(series[3][106 + 4])
    found = search_forest(df, replace(CFG, forest_depth=5), grid=((3, "all"), (5, "all"), (5, "sqrt"))).collect()
    assert {(r["trees"], r["features"]) for r in found} == {(3, "all"), (5, "all"), (5, "sqrt")}
    assert [r["best"] for r in found].count(True) == 1
    assert min(found, key=lambda r: r["rmse"])["best"]


def plain_tree(bins, y, w, tree, shape, node=0, level=0):
    """{node: mean} and {node: (feature, cut)} of one tree, grown depth first over all cuts."""
    rows = w > 0
    bins, y, w = bins[rows], y[rows], w[rows]
    means, cuts = {node: (w[:, None] * y).sum(0) / w.sum()}, {}
    if level == shape.depth:
        return means, cuts
    whole = ((w[:, None] * y).sum(0) ** 2).sum() / w.sum()
    best = (0.0, None, None)
    for f in trees.chosen(tree, np.array([node]), shape.features, shape.tried)[0]:
        for cut in range(bins[:, f].max()):
            left = bins[:, f] <= cut
            if not left.any():
                continue
            parts = [((w[s, None] * y[s]).sum(0) ** 2).sum() / w[s].sum() for s in (left, ~left)]
            gain = round(sum(parts) - whole, 6)
            if gain > best[0]:
                best = (gain, f, cut)
    if best[1] is not None:
        cuts[node] = best[1:]
        left = bins[:, best[1]] <= best[2]
        for side, at in ((1, left), (2, ~left)):
            m, c = plain_tree(bins[at], y[at], w[at], tree, shape, 2 * node + side, level + 1)
            means, cuts = means | m, cuts | c
    return means, cuts


@pytest.mark.parametrize("tasks", [1, 5])
def test_joint_trees_equal_plain_growth(spark, tasks):
    """Trees of two groups, however the rows are dealt out, equal trees grown one node after the other."""
    rng = np.random.default_rng(3)
    shape = trees.Shape(3, 4, 8, 5, 2, 3)
    data = []
    for k, n in ((0, 400), (1, 90)):
        bins = rng.integers(0, 8, (n, 5))
        y = np.column_stack([bins[:, 0] * (bins[:, 1] > 3), bins[:, 2]]) + rng.normal(0, 0.5, (n, 2))
        data.append((bins, y, rng.integers(0, trees.PRIME, n)))
    rows = [(k, b.tolist(), int(r), y.tolist()) for k, d in enumerate(data) for b, y, r in zip(*d)]
    df = spark.createDataFrame(rows, "k int, bins array<smallint>, row long, y array<double>").repartition(tasks)
    got = trees.grow(df, shape, 2)
    for k, (bins, y, row) in enumerate(data):
        for tree in range(3):
            means, cuts = plain_tree(bins, y, trees.bootstrap(row, tree), tree, shape)
            assert {n: (int(got.feature[k, tree, n]), int(got.cut[k, tree, n])) for n in np.flatnonzero(got.feature[k, tree] >= 0)} == cuts
            for n, m in means.items():
                assert got.mean[k, tree, n] == pytest.approx(m)


def test_bootstrap_draws_like_poisson():
    row = np.arange(200_000) * 7 + 12345
    counts = np.bincount(trees.bootstrap(row, 3), minlength=4) / len(row)
    assert counts[:4] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.01)
    assert abs(np.corrcoef(trees.bootstrap(row, 3), trees.bootstrap(row, 4))[0, 1]) < 0.02


def test_forest_rounds_of_groups(spark, data, monkeypatch):
    """Groups that do not fit one growth grow in later rounds, with the same forecasts."""
    cfg = replace(CFG, forest_depth=3)
    once = forecast_forest(data[0], cfg, 2).orderBy("scope", KEY, "First_day", "step").collect()
    monkeypatch.setattr(trees, "NODES", 1)
    assert forecast_forest(data[0], cfg, 2).orderBy("scope", KEY, "First_day", "step").collect() == once


# --- features, scaling, scores ------------------------------------------------------------------------------


def test_multi_step_train_rows(spark, data):
    df, series = data
    made = multi_step_features(df, CFG)
    counts = {r["split"]: r["count"] for r in made.groupBy("split").count().collect()}
    assert counts == {"train": 5 * (106 - 26 - 48), "valid": 5 * 52}
    row = made.where((F.col(KEY) == 1) & (F.col("split") == "train")).orderBy("First_day").first()
    y = series[1]
    assert row["lag_total_qty_26"] == y[0] and row["total_qty_next_week_26"] == y[52]
    assert row["mean_tqs_12"] == pytest.approx(y[15:27].mean())
    first = made.where((F.col(KEY) == 1) & (F.col("split") == "valid")).orderBy("First_day").first()
    assert first["lag_total_qty_1"] is None  # lags do not cross the split


def test_one_step_features_and_imputation(spark, data):
    df, series = data
    made = one_step_features(df, CFG)
    assert made.where("split = 'train'").count() == 5 * 105
    filled = impute_mean(made, ["lag_total_qty_1"], F.col("split") == "train")
    first = filled.where((F.col(KEY) == 1) & (F.col("split") == "valid")).orderBy("First_day").first()
    want = np.mean([y[:104] for y in series.values()])
    assert first["lag_total_qty_1"] == pytest.approx(want)


def test_scaling_round_trip_and_constants(spark):
    df = demand(spark, [(1, 0, 3), (1, 1, 5), (2, 0, 7), (2, 1, 7)])
    for by in (KEY, GROUP, None):
        scaled = scale(df, QTY, by)
        back = unscale(scaled, [QTY])
        assert values(back) == pytest.approx(values(df))
    got = values(scale(df, QTY, KEY))
    assert got == {(1, 0): -1.0, (1, 1): 1.0, (2, 0): 0.0, (2, 1): 0.0}
    on_first = scale(df, QTY, GROUP, fit=F.col(KEY) == 1)
    assert values(on_first)[2, 0] == pytest.approx((7 - 4) / 1)


def test_invert_difference(spark):
    changes = spark.createDataFrame([(1, 1, 2.0), (1, 2, -1.0), (1, 3, 4.0)], "product_id long, step int, yhat double")
    last = spark.createDataFrame([(1, 10.0)], "product_id long, last_value double")
    got = [r["yhat"] for r in invert_difference(changes, last).orderBy("step").collect()]
    assert got == [12.0, 11.0, 15.0]


def test_share_split(spark):
    df = demand(spark, [(1, w, 1) for w in range(20)] + [(2, w, 1) for w in range(7)])
    got = share_split(df, 0.85).where("part = 'train'").groupBy(KEY).count().collect()
    assert {r[KEY]: r["count"] for r in got} == {1: int(0.85 * 20), 2: int(0.85 * 7)}


def test_scores_and_tables(spark):
    rows = [("m", 1, 1, 1, 10.0, 8.0), ("m", 2, 1, 1, 0.0, 4.0), ("m", 3, 2, 1, 0.0, 1.0), ("k", 3, 2, 1, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "model string, product_id long, sis_group_id long, step int, y double, yhat double")
    total = score(df.where("model = 'm'"), []).first()
    assert total["rmse"] == pytest.approx(np.sqrt(21 / 3)) and total["wmape"] == pytest.approx(0.7)
    assert score(df.where("product_id = 3"), [KEY]).first()["wmape"] is None  # nothing sold
    scores = scores_by_group_and_total(df, (1,))
    table = step_group_table(scores.where("model = 'm'"), "rmse").first()
    assert table["step"] == "step_1" and table["1"] == pytest.approx(np.sqrt(10)) and table["2"] == 1.0
    assert table["total"] == pytest.approx(np.sqrt(7))
    places = {(r["model"], r["grp"]): r["place"] for r in leaderboard(scores).collect()}
    assert places["k", "2"] == 1 and places["m", "2"] == 2 and places["m", "1"] == 1


def test_naive_rows(spark, data):
    df, series = data
    rows = forecast_naive(df, CFG)
    assert rows.where("step = 26").count() == 5 * 26
    r = rows.where((F.col(KEY) == 1) & (F.col("step") == 12)).orderBy("First_day").first()
    assert (r["yhat"], r["y"]) == (series[1][106], series[1][118])


def test_series_keep_week_order(spark, data):
    df, series = data
    got = {r[KEY]: r["y"] for r in series_arrays(df.repartition(7), QTY).collect()}
    assert got == {p: y.tolist() for p, y in series.items()}


def test_evaluation_saves_score_tables(spark, data):
    from weekloom.plans.evaluation import evaluate
    from weekloom.sources.tables import write_table

    df, _ = data
    cfg = replace(CFG, country="EVL")
    write_table(df, cfg.table("Filtered"))
    board = evaluate(spark, cfg, ("naive", "arima", "window"))
    assert {r["model"] for r in board.collect()} == {"naive", "arima", "window"}
    table = spark.table("RMSE_window_EVL")
    assert table.columns == ["step", "0", "1", "total"]
    assert {r["step"] for r in table.collect()} == {f"step_{s}" for s in cfg.steps}
    assert {r["step"] for r in spark.table("WMAPE_arima_EVL").collect()} == {f"step_{s}" for s in cfg.arima_steps}


def test_scaling_on_train_weeks_only(spark, data):
    df, series = data
    cfg = replace(CFG, scale_fit_on="train")
    var_rows = {(r[KEY], r["step"]): r for r in forecast_var(df, cfg).collect()}
    members = [2, 4]
    y = np.array([series[p] for p in members]).T
    mu, sd = y[:-30].mean(0), y[:-30].std(0)
    s = (y - mu) / sd
    x = np.diff(s[:-30], axis=0)
    made = (s[-31] + forecast_weights(x @ x.T, 10, 30) @ x) * sd + mu
    for i, p in enumerate(members):
        assert [var_rows[p, h + 1]["yhat"] for h in range(30)] == pytest.approx(made[:, i].tolist(), abs=1e-6)
        assert var_rows[p, 30]["y"] == pytest.approx(series[p][-1])
    window_rows = forecast_window(df, cfg)
    assert window_rows.where("yhat is null or yhat < 0").count() == 0


def test_join_beyond_the_broadcast_limit_is_a_shuffle_join(spark):
    left = spark.range(100).withColumn("k", F.col("id") % 3)
    right = stage(spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")), "right")
    small, large = join_small(left, right, "k"), join_small(left, right, "k", max_rows=2)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    hinted = [df._jdf.queryExecution().analyzed().toString() for df in (small, large)]
    assert "strategy=broadcast" in hinted[0] and "strategy=broadcast" not in hinted[1]


def test_staged_parts_form_one_table(spark):
    parts = (spark.range(i, i + 2) for i in (0, 10, 20))
    assert sorted(r[0] for r in stage_all(parts, "parts").collect()) == [0, 1, 10, 11, 20, 21]


def test_shared_targets_and_origin(spark, data):
    """Only cells that all models have count; with one origin all models meet in the same weeks."""
    from weekloom.models.var import forecast_var as var_rows
    from weekloom.operators.metrics import shared_targets
    from weekloom.plans.evaluation import compare_shared, shared_origin

    day = dt.date(2020, 1, 6)
    rows = [("a", 1, 1, 1, day, 1.0, 2.0), ("a", 2, 1, 1, day, 1.0, 2.0), ("b", 1, 1, 1, day, 1.0, 3.0)]
    rows += [("b", 2, 1, 1, day + dt.timedelta(days=7), 1.0, 3.0), ("b", 2, 1, 2, day, 1.0, 3.0), ("b", 3, 1, 1, day, None, 1.0)]
    small = spark.createDataFrame(
        rows, "model string, product_id long, sis_group_id long, step int, target_week date, y double, yhat double"
    )
    assert sorted((r["model"], r[KEY], r["step"]) for r in shared_targets(small, 2).collect()) == [("a", 1, 1), ("b", 1, 1)]

    df, series = data
    fair = shared_origin(CFG)
    made = [forecast_naive(df, fair), forecast_arima(df, fair), var_rows(df, fair), forecast_window(df, fair)]
    made.append(forecast_ridge(df, fair, GRID[:1]))
    for m in made:
        for r in m.collect():
            at = (r["target_week"] - dt.date(2020, 1, 6)).days // 7
            assert r["y"] == pytest.approx(series[r[KEY]][at])
    board = compare_shared(made, fair).collect()
    assert {r["n"] for r in board if r["grp"] == "total"} == {5}
    assert {(r["model"], r["step"]) for r in board if r["grp"] == "total"} == {
        (m, s) for m in ("naive", "arima", "var", "window", "ridge") for s in CFG.steps
    }
    # By default the splits differ: nothing in common with ARIMA.
    assert compare_shared([forecast_arima(df, CFG), *made[3:]], CFG).count() == 0
