"""DuckDB SQL of models that are grown or searched: trees, order searches, constrained fits."""

from __future__ import annotations

from math import exp, factorial

from weekloom.checks.oracle import COV, NUMBERED, P, STEPS_AHEAD, base, day, num

SQL: dict[str, str] = {}

# --- random forests --------------------------------------------------------------------------------------

PRIME = 2**31 - 1
WITHIN = "PARTITION BY scope, product_id, split ORDER BY First_day"


def _scrambled(a: str, b: str) -> str:
    first = f"(({a}) * 48271 + ({b}) * 69621 + 12345) % {PRIME}"
    return f"((({first}) * ({first})) % {PRIME} * 16807 + ({b})) % {PRIME}"


def _mean(k: int) -> str:
    frame = f"OVER ({WITHIN} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) {frame} = {k} THEN avg(total_qty) {frame} END"


FEATURES = (
    ["total_qty", "sales_date_weekly_number", "sales_week", "sales_year", "sis_sub_family_id", "sis_group_id", "vendor_id"]
    + ["is_stock_numeric", "FR_numeric", "etim_class_numeric"]
    + [f"lag(total_qty, {k}) OVER ({WITHIN})" for k in STEPS_AHEAD]
    + [f"total_qty - lag(total_qty, {k}) OVER ({WITHIN})" for k in STEPS_AHEAD]
    + [_mean(k) for k in (4, 12, 26)]
)
TARGETS = [f"lead(total_qty, {k}) OVER ({WITHIN})" for k in STEPS_AHEAD]
Y = range(len(TARGETS))


def forest(trees: int, depth: int, tried: int) -> str:
    """All steps of the forests per group and over all products, level by level."""
    poisson = [int(PRIME * exp(-1) * sum(1 / factorial(i) for i in range(k + 1))) for k in range(8)]
    drawn = _scrambled("row", "tree")
    steps = [
        base("encoded"),
        """sg AS (SELECT sis_group_id, avg(total_qty) AS mu, CASE WHEN stddev_pop(total_qty) = 0 THEN 1
            ELSE stddev_pop(total_qty) END AS sd FROM filtered GROUP BY 1)""",
        """st AS (SELECT avg(total_qty) AS mu, CASE WHEN stddev_pop(total_qty) = 0 THEN 1
            ELSE stddev_pop(total_qty) END AS sd FROM filtered)""",
        """scaled AS (SELECT 'group' AS scope, 'group/' || e.sis_group_id AS g, mu, sd, e.* REPLACE ((total_qty - mu) / sd AS total_qty)
            FROM encoded e JOIN sg ON sg.sis_group_id = e.sis_group_id
            UNION ALL SELECT 'total', 'total/total', mu, sd, e.* REPLACE ((total_qty - mu) / sd AS total_qty) FROM encoded e CROSS JOIN st)""",
        f"""made AS (SELECT scope, g, mu, sd, product_id, sis_group_id AS grp, First_day, split,
            [{", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURES)}] AS x, [{", ".join(TARGETS)}] AS y,
            row_number() OVER ({WITHIN}) AS rn, count(*) OVER (PARTITION BY scope, product_id, split) AS cnt FROM scaled)""",
        f"""kept AS MATERIALIZED (SELECT *, row_number() OVER () AS id,
            (product_id % {PRIME} * 613 + date_diff('day', DATE '1970-01-01', First_day)) % {PRIME} AS row
            FROM made WHERE split = 'valid' OR (rn > 26 AND cnt - rn >= 48))""",
        "cells AS (SELECT id, g, split, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS f FROM kept)",
        "means AS (SELECT g, f, avg(x) AS mean FROM cells WHERE split = 'train' GROUP BY 1, 2)",
        "known AS (SELECT id, g, split, f, round(coalesce(x, mean), 6) AS x FROM cells JOIN means USING (g, f))",
        """ranked AS (SELECT g, f, x, row_number() OVER (PARTITION BY g, f ORDER BY x) AS rank, count(*) OVER (PARTITION BY g, f) AS n
            FROM known WHERE split = 'train')""",
        """cuts AS (SELECT g, f, list(DISTINCT x) AS cuts FROM ranked
            JOIN (SELECT unnest(range(1, 32)) AS k) ON rank = ceil(n * k / 32.0::DOUBLE) GROUP BY 1, 2)""",
        """coded AS MATERIALIZED (SELECT id, f, len(list_filter(cuts, lambda c: c < x)) AS bin FROM known JOIN cuts USING (g, f))""",
        f"trees AS (SELECT unnest(range({trees})) AS tree)",
        f"""chosen AS MATERIALIZED (SELECT tree, node, f FROM trees CROSS JOIN (SELECT unnest(range({(1 << depth) - 1})) AS node)
            CROSS JOIN (SELECT unnest(range({len(FEATURES)})) AS f)
            QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {_scrambled(f"(tree * 4099 + node) % {PRIME}", "1000 + f")}, f) <= {tried})""",
        f"""a0 AS MATERIALIZED (SELECT * FROM (SELECT id, g, y, tree, 0 AS node,
            {" + ".join(f"CAST({drawn} > {c} AS INTEGER)" for c in poisson)} AS w
            FROM kept CROSS JOIN trees WHERE split = 'train') WHERE w > 0)""",
        "v0 AS MATERIALIZED (SELECT id, g, tree, 0 AS node, CAST(NULL AS DOUBLE[]) AS mean FROM kept CROSS JOIN trees WHERE split = 'valid')",
    ]
    total = "OVER (PARTITION BY g, tree, node, f)"
    upto = "OVER (PARTITION BY g, tree, node, f ORDER BY bin)"
    for level in range(depth):
        own = "[" + ", ".join(f"s{i} / n" for i in Y) + "]"
        left = "[" + ", ".join(f"l{i} / nl" for i in Y) + "]"
        right = "[" + ", ".join(f"(s{i} - l{i}) / (n - nl)" for i in Y) + "]"
        gain = " + ".join(f"l{i} * l{i} / nl + (s{i} - l{i}) * (s{i} - l{i}) / (n - nl) - s{i} * s{i} / n" for i in Y)
        steps += [
            f"""h{level} AS (SELECT a.g, tree, node, f, bin, sum(w) AS n, {", ".join(f"sum(w * y[{i + 1}]) AS s{i}" for i in Y)}
                FROM a{level} a JOIN chosen USING (tree, node) JOIN coded USING (id, f) GROUP BY 1, 2, 3, 4, 5)""",
            f"""c{level} AS (SELECT g, tree, node, f, bin, sum(n) {total} AS n, sum(n) {upto} AS nl,
                {", ".join(f"sum(s{i}) {total} AS s{i}, sum(s{i}) {upto} AS l{i}" for i in Y)} FROM h{level})""",
            f"""b{level} AS MATERIALIZED (SELECT g, tree, node, f, bin, {left} AS l, {right} AS r FROM c{level}
                WHERE nl > 0 AND n - nl > 0 AND round({gain}, 6) > 0
                QUALIFY row_number() OVER (PARTITION BY g, tree, node ORDER BY round({gain}, 6) DESC, f, bin) = 1)""",
            f"""a{level + 1} AS MATERIALIZED (SELECT id, a.g, y, tree, 2 * node + 1 + CAST(coded.bin > b.bin AS INTEGER) AS node, w
                FROM a{level} a JOIN b{level} b USING (g, tree, node) JOIN coded USING (id, f))""",
            f"""v{level + 1} AS MATERIALIZED (SELECT v.id, v.g, tree, CASE WHEN b.f IS NULL THEN node ELSE 2 * node + 1 + CAST(coded.bin > b.bin AS INTEGER) END AS node,
                CASE WHEN b.f IS NULL THEN mean WHEN coded.bin > b.bin THEN r ELSE l END AS mean
                FROM v{level} v LEFT JOIN b{level} b USING (g, tree, node) LEFT JOIN coded ON coded.id = v.id AND coded.f = b.f)""",
        ]
        if not level:
            steps.append(f"root AS (SELECT DISTINCT g, tree, {own} AS own FROM c0 QUALIFY row_number() OVER (PARTITION BY g, tree ORDER BY f, bin) = 1)")
    steps.append(
        f"""made_ AS (SELECT id, {", ".join(f"avg(coalesce(mean, own)[{i + 1}]) AS p{i}" for i in Y)}
            FROM v{depth} JOIN root USING (g, tree) GROUP BY id)"""
    )
    out = [
        f"""SELECT 'forest' AS model, scope, product_id, grp AS sis_group_id, {day()}, {k} AS step,
        round(y[{i + 1}] * sd + mu, 9) + 0.0::DOUBLE AS y, round(p{i} * sd + mu, 9) + 0.0::DOUBLE AS yhat FROM kept JOIN made_ USING (id) WHERE y[{i + 1}] IS NOT NULL"""
        for i, k in enumerate(STEPS_AHEAD)
    ]
    return ",\n".join(steps) + "\n" + " UNION ALL ".join(out)


SQL["forest_stump"] = forest(1, 1, len(FEATURES))
SQL["forest_small"] = forest(5, 4, 5)

# --- unit root test with its choice of lags -------------------------------------------------------------------


def _eliminated(name: str, source: str, size: int) -> str:
    """Elimination of the first ``size`` rows of each matrix ``m``, one per step ``k``; null pivots are passed over."""
    return f"""{name} AS (
        SELECT product_id, 0 AS k, m FROM {source}
        UNION ALL
        SELECT product_id, k + 1, CASE WHEN m[k + 1][k + 1] > 1e-9 THEN list_transform(m, lambda r: list_transform(r,
            lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1])) ELSE m END FROM {name} WHERE k < {size})"""


def _matrix(columns: list[str]) -> str:
    return "[" + ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in columns) + "]" for a in columns) + "]"


def _tested(table: str, weeks: int) -> list[str]:
    """``tested`` (stat, p value, lags, rows) of the series ``x`` in ``table``, ordered by ``t``; all of ``weeks`` values."""
    most = min(-int(-12.0 * (weeks / 100.0) ** 0.25 // 1), weeks // 2 - 2)
    order = "OVER (PARTITION BY product_id ORDER BY t)"
    lagged = [f"lag(dx, {k}) {order} AS d{k}" for k in range(1, most + 1)]
    names = [f"d{k}" for k in range(1, most + 1)]
    some = [f"CASE WHEN {k} <= used THEN d{k} ELSE 0 END" for k in range(1, most + 1)]
    size = most + 3
    return [
        f"changes AS (SELECT product_id, t, lag(x) {order} AS level, x - lag(x) {order} AS dx FROM {table})",
        f"lagged AS (SELECT *, {', '.join(lagged)} FROM changes)",
        f"g1 AS (SELECT product_id, {_matrix(['1.0', 'level', *names, 'dx'])} AS m FROM lagged WHERE d{most} IS NOT NULL GROUP BY 1)",
        _eliminated("e1", "g1", most + 2),
        f"""lags AS (SELECT product_id, k - 2 AS used FROM e1 WHERE k >= 2
            QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY {weeks - 1 - most} * ln(m[{size}][{size}] / {weeks - 1 - most}) + 2 * k, k) = 1)""",
        f"""own AS (SELECT lagged.* REPLACE ({", ".join(f"{s} AS {n}" for s, n in zip(some, names))}), used
            FROM lagged JOIN lags USING (product_id) WHERE t >= used + 2)""",
        f"g2 AS (SELECT product_id, {_matrix(['1.0', *names, 'level', 'dx'])} AS m FROM own GROUP BY 1)",
        _eliminated("e2", "g2", most + 1),
        f"""stats AS (SELECT product_id, used AS n_lags, {weeks - 1} - used AS n_obs,
            m[{size - 1}][{size}] / m[{size - 1}][{size - 1}] / sqrt((m[{size}][{size}] - m[{size - 1}][{size}] ** 2 / m[{size - 1}][{size - 1}])
            / ({weeks - 1} - used - (used + 2)) / m[{size - 1}][{size - 1}]) AS stat FROM e2 JOIN lags USING (product_id) WHERE k = {most + 1})""",
        """quantile AS (SELECT *, CASE WHEN stat <= -1.61 THEN 2.1659 + 1.4412 * stat + 0.038269 * stat ** 2
            ELSE 1.7339 + 0.93202 * stat - 0.12745 * stat ** 2 - 0.010368 * stat ** 3 END AS z FROM stats)""",
        # The normal distribution by Simpson's rule from 0 to z.
        """tested AS (SELECT *, CASE WHEN stat < -18.83 THEN 0 WHEN stat > 2.74 THEN 1 WHEN z < -9 THEN 0 ELSE 0.5 + z / 3000 * list_sum(list_transform(range(1001),
            lambda i: CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(0 - z * z * i * i / 2000000))) / sqrt(2 * pi()) END AS pvalue FROM quantile)""",
    ]


def _recursive(steps: str) -> str:
    return steps.replace("WITH ", "WITH RECURSIVE ", 1)


SERIES = "series AS (SELECT product_id, rn AS t, total_qty AS x FROM numbered)"
SQL["adf_test"] = (
    _recursive(base("filtered"))
    + NUMBERED
    + ",\n".join(["", SERIES, *_tested("series", 158)])
    + f""" SELECT product_id, {num('stat')}, {num('pvalue')}, CAST(n_lags AS INTEGER) AS n_lags, CAST(n_obs AS INTEGER) AS n_obs,
        CASE WHEN pvalue < 0.05 THEN 0 ELSE 1 END AS d FROM tested"""
)


def _count(of: str, series: str, weeks: int) -> str:
    steps = ",\n".join(["", series, *_tested("series", weeks)])
    select = f"SELECT '{of}' AS \"of\", count(*) AS series, count(*) FILTER (round(pvalue, 4) > 0.05) AS non_stationary FROM tested"
    return f"SELECT * FROM ({_recursive(base('filtered'))}{NUMBERED}{steps} {select})"


CHANGES = f"""series AS (SELECT product_id, rn - 1 AS t, v AS x FROM (SELECT product_id, rn, cnt, total_qty - lag(total_qty) {P} AS v FROM numbered)
    WHERE rn <= cnt - 30 AND rn > 1)"""
SQL["non_stationary_count"] = (
    _count("level", SERIES + " ", 128).replace("FROM numbered)", "FROM numbered WHERE rn <= cnt - 30)", 1)
    + " UNION ALL "
    + _count("difference", CHANGES, 127)
)

# --- ridge -----------------------------------------------------------------------------------------------------

SQL["ridge_kkt"] = """
    SELECT lags, alpha, covariates, fit_intercept, CAST(chunk AS INTEGER) AS chunk, true AS optimal
    FROM (SELECT unnest(['1,2,3,4,12,52', '1,2,3,4,12,26,52']) AS lags)
    CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.001::DOUBLE]) AS alpha)
    CROSS JOIN (SELECT unnest(['sales_year', 'sales_week', 'sales_year,sales_week']) AS covariates)
    CROSS JOIN (SELECT unnest([true, false]) AS fit_intercept) CROSS JOIN (SELECT unnest([1, 2, 6, 12, 26]) AS chunk)
    WHERE (SELECT count(*) FROM lineitem) > 0"""


def _one_lag(train: int, steps: int, suffix: str) -> str:
    """Weight and bias of the models of one lag on the first ``train`` rows, and their forecasts of the next."""
    return f"""
    sums{suffix} AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy
        FROM (SELECT rn, total_qty AS y, lag(total_qty) {P} AS x FROM numbered) WHERE rn BETWEEN 53 AND {train}),
    fit{suffix} AS (SELECT *, CASE WHEN fit_intercept THEN (sy - sx * w) / n ELSE 0 END AS bias FROM (
        SELECT *, greatest(CASE WHEN fit_intercept THEN (sxy - sx * sy / n) / (sxx - sx * sx / n + alpha) ELSE sxy / (sxx + alpha) END, 0) AS w
        FROM sums{suffix} CROSS JOIN params_)),
    rolled{suffix} AS (
        SELECT id, product_id, 0 AS step, total_qty AS yhat FROM fit{suffix} CROSS JOIN numbered WHERE rn = {train}
        UNION ALL
        SELECT r.id, product_id, step + 1, bias + w * yhat FROM rolled{suffix} r JOIN fit{suffix} f ON f.id = r.id WHERE step < {steps}),
    made{suffix} AS (SELECT id, r.product_id, k.sis_group_id, step, k.total_qty AS y, yhat
        FROM rolled{suffix} r JOIN numbered k ON k.product_id = r.product_id AND k.rn = {train} + step WHERE step > 0)"""


ONE_LAG = (
    _recursive(base("filtered"))
    + NUMBERED
    + """, params_ AS (SELECT CAST(i * 2 + j AS INTEGER) AS id, [0.1::DOUBLE, 0.2::DOUBLE, 0.001::DOUBLE][i + 1] AS alpha, j = 0 AS fit_intercept
        FROM (SELECT unnest(range(3)) AS i) CROSS JOIN (SELECT unnest(range(2)) AS j)),"""
    + _one_lag(100, 32, "_v")
    + """, scored AS (SELECT id, sqrt(avg((y - yhat) * (y - yhat))) AS rmse FROM made_v GROUP BY id),
    marked AS (SELECT id, alpha, fit_intercept, rmse, row_number() OVER (ORDER BY rmse, id) = 1 AS best FROM scored JOIN params_ USING (id))"""
)
SQL["ridge_grid_small"] = (
    ONE_LAG
    + f""" SELECT id, '1' AS lags, {num('alpha')}, '' AS covariates, fit_intercept, CAST(1 AS INTEGER) AS chunk, {num('rmse')}, best FROM marked"""
)
SQL["ridge_one_lag"] = (
    ONE_LAG
    + ","
    + _one_lag(132, 26, "_t")
    + f""" SELECT 'ridge' AS model, product_id, sis_group_id, CAST(step AS INTEGER) AS step,
        CAST(First_day AS VARCHAR) AS target_week, {num('y')}, {num('yhat')},
        'lags=1 alpha=' || alpha || ' covariates= intercept=' || CASE WHEN fit_intercept THEN 'True' ELSE 'False' END || ' chunk=1' AS params
    FROM made_t JOIN marked USING (id) JOIN (SELECT product_id, rn - 132 AS step, First_day FROM numbered) USING (product_id, step) WHERE best"""
)
