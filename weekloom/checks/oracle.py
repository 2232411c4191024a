"""DuckDB SQL with the same results as the registered queries, written independently of them."""

from __future__ import annotations

ATTRS = "is_stock, etim_class_id, etim_class, sis_sub_family_id, sis_sub_family, sis_group_id, vendor_id"

# Shared steps; each text is one WITH item. A query lists the ones it needs by naming the last.
STEPS: dict[str, str] = {
    "sold": r"""
        SELECT CAST(regexp_extract(p_brand, '^Brand#(\d+)$', 1) AS BIGINT) AS brand, p_brand AS label,
               list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type) AS kind,
               CAST(l_shipdate AS DATE) AS day, l_quantity, l_extendedprice, l_discount
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "raw": """
        SELECT brand * 10 + kind AS product_id, CAST(year(day) AS INTEGER) AS sales_year,
               CAST(1 + date_diff('day', CAST(date_trunc('week', date_trunc('year', day)) AS DATE),
                                  CAST(date_trunc('week', day) AS DATE)) // 7 AS INTEGER) AS sales_week,
               sum(l_quantity) AS total_qty, avg(l_extendedprice / l_quantity) AS avg_sales_price,
               sum(l_extendedprice * (l_discount + 0.0)) AS total_discount_value,
               count(*) AS sales_date_weekly_number,
               CASE WHEN brand % 2 = 0 THEN 'Y' ELSE 'N' END AS is_stock,
               'EC' || lpad(CAST(brand AS VARCHAR), 6, '0') AS etim_class_id, label AS etim_class,
               brand AS sis_sub_family_id, label AS sis_sub_family, CAST(kind AS BIGINT) AS sis_group_id,
               brand % 7 AS vendor_id
        FROM sold GROUP BY brand, label, kind, 2, 3""",
    "typed": """
        SELECT *, make_date(sales_year, 1, 1)
                  + CAST((sales_week - 1) * 7 - (isodow(make_date(sales_year, 1, 1)) - 1) AS INTEGER) AS First_day
        FROM raw""",
    "merged": """
        SELECT product_id, First_day, sum(total_qty) AS total_qty, avg(avg_sales_price) AS avg_sales_price,
               sum(total_discount_value) AS total_discount_value,
               CAST(sum(sales_date_weekly_number) AS BIGINT) AS sales_date_weekly_number,
               arg_min(sales_year, sales_year * 100 + sales_week) AS sales_year,
               arg_min(sales_week, sales_year * 100 + sales_week) AS sales_week,
               arg_min(is_stock, sales_year * 100 + sales_week) AS is_stock,
               arg_min(etim_class_id, sales_year * 100 + sales_week) AS etim_class_id,
               arg_min(etim_class, sales_year * 100 + sales_week) AS etim_class,
               arg_min(sis_sub_family_id, sales_year * 100 + sales_week) AS sis_sub_family_id,
               arg_min(sis_sub_family, sales_year * 100 + sales_week) AS sis_sub_family,
               arg_min(sis_group_id, sales_year * 100 + sales_week) AS sis_group_id,
               arg_min(vendor_id, sales_year * 100 + sales_week) AS vendor_id
        FROM typed GROUP BY product_id, First_day""",
    "recent": """
        SELECT * FROM merged
        WHERE First_day IN (SELECT DISTINCT First_day FROM merged ORDER BY First_day DESC LIMIT 158)""",
    "flagged": """
        SELECT r.*, n > 100 AS Forte_rotation, n
        FROM recent r JOIN (SELECT product_id, count(DISTINCT First_day) AS n FROM recent GROUP BY 1) USING (product_id)""",
    "prepared": "SELECT * EXCLUDE (n) FROM flagged WHERE n > 40",
    "weeks": """
        SELECT CAST(unnest(generate_series(min(First_day), max(First_day), INTERVAL 7 DAY)) AS DATE) AS First_day
        FROM prepared""",
    "kinds": "SELECT DISTINCT product_id, Forte_rotation FROM prepared",
    "attrs": f"""
        SELECT product_id, {ATTRS} FROM prepared
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY First_day DESC) = 1""",
    "grid": """
        SELECT k.product_id, k.Forte_rotation AS fr, w.First_day AS fd, p.* EXCLUDE (product_id, First_day),
               p.product_id IS NULL AS hole
        FROM kinds k CROSS JOIN weeks w
        LEFT JOIN prepared p ON p.product_id = k.product_id AND p.First_day = w.First_day""",
    "around": """
        SELECT *,
               last_value(total_qty IGNORE NULLS) OVER pre AS q0, first_value(total_qty IGNORE NULLS) OVER post AS q1,
               last_value(avg_sales_price IGNORE NULLS) OVER pre AS p0,
               first_value(avg_sales_price IGNORE NULLS) OVER post AS p1,
               last_value(total_discount_value IGNORE NULLS) OVER pre AS d0,
               first_value(total_discount_value IGNORE NULLS) OVER post AS d1,
               last_value(sales_date_weekly_number IGNORE NULLS) OVER pre AS c0,
               first_value(sales_date_weekly_number IGNORE NULLS) OVER post AS c1
        FROM grid
        WINDOW pre AS (PARTITION BY product_id ORDER BY fd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               post AS (PARTITION BY product_id ORDER BY fd ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
    "filled": """
        SELECT product_id, fd AS First_day, fr AS Forte_rotation,
               CASE WHEN fr AND NOT hole THEN sales_week ELSE CAST(week(fd) AS INTEGER) END AS sales_week,
               CASE WHEN fr AND NOT hole THEN sales_year ELSE CAST(year(fd) AS INTEGER) END AS sales_year,
               CASE WHEN NOT hole THEN total_qty WHEN fr THEN (coalesce(q0, q1) + coalesce(q1, q0)) / 2
                    ELSE 0 END AS total_qty,
               CASE WHEN NOT hole THEN avg_sales_price WHEN fr THEN (coalesce(p0, p1) + coalesce(p1, p0)) / 2
                    ELSE 0 END AS avg_sales_price,
               CASE WHEN NOT hole THEN total_discount_value WHEN fr THEN (coalesce(d0, d1) + coalesce(d1, d0)) / 2
                    ELSE 0 END AS total_discount_value,
               CAST(CASE WHEN NOT hole THEN sales_date_weekly_number
                         WHEN fr THEN round_even((coalesce(c0, c1) + coalesce(c1, c0)) / 2.0, 0)
                         ELSE 0 END AS BIGINT) AS sales_date_weekly_number
        FROM around""",
    "completed": "SELECT * FROM filled JOIN attrs USING (product_id)",
    "limits": """
        SELECT avg(total_qty) + 3 * stddev_pop(total_qty) AS lq,
               avg(avg_sales_price) + 3 * stddev_pop(avg_sales_price) AS lp,
               avg(total_discount_value) + 3 * stddev_pop(total_discount_value) AS ld
        FROM prepared""",
    "normal": """
        SELECT c.*, CASE WHEN total_qty < lq THEN total_qty END AS nq,
               CASE WHEN avg_sales_price < lp THEN avg_sales_price END AS np,
               CASE WHEN total_discount_value < ld THEN total_discount_value END AS nd
        FROM completed c CROSS JOIN limits""",
    "neighbours": """
        SELECT *,
               last_value(nq IGNORE NULLS) OVER pre AS q0, first_value(nq IGNORE NULLS) OVER post AS q1,
               last_value(np IGNORE NULLS) OVER pre AS p0, first_value(np IGNORE NULLS) OVER post AS p1,
               last_value(nd IGNORE NULLS) OVER pre AS d0, first_value(nd IGNORE NULLS) OVER post AS d1
        FROM normal
        WINDOW pre AS (PARTITION BY product_id ORDER BY First_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               post AS (PARTITION BY product_id ORDER BY First_day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
    "filtered": f"""
        SELECT product_id, First_day, Forte_rotation, sales_week, sales_year, sales_date_weekly_number, {ATTRS},
               coalesce(nq, (coalesce(q0, q1) + coalesce(q1, q0)) / 2, total_qty) AS total_qty,
               coalesce(np, (coalesce(p0, p1) + coalesce(p1, p0)) / 2, avg_sales_price) AS avg_sales_price,
               coalesce(nd, (coalesce(d0, d1) + coalesce(d1, d0)) / 2, total_discount_value) AS total_discount_value,
               nq IS NULL AND coalesce(q0, q1) IS NULL AS stuck_qty
        FROM neighbours""",
    "split": """
        SELECT *, CASE WHEN First_day < DATE '2000-10-30' THEN 'train' ELSE 'valid' END AS split FROM filtered""",
    "encoded": """
        SELECT *, CASE is_stock WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS is_stock_numeric,
               CAST(Forte_rotation AS INTEGER) AS FR_numeric,
               TRY_CAST(substr(etim_class_id, 3, 6) AS DOUBLE) AS etim_class_numeric
        FROM split""",
}


def base(*last: str) -> str:
    """WITH clause holding the steps up to the latest one named."""
    names = list(STEPS)
    upto = max(names.index(n) for n in last)
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in names[: upto + 1])


# Adding zero below turns -0.0 into 0.0.
def num(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0::DOUBLE AS {name or expr}"


def single(expr: str, name: str | None = None) -> str:
    return f"CAST(CAST({expr} AS FLOAT) AS DOUBLE) + 0.0::DOUBLE AS {name or expr}"


def day(expr: str = "First_day", name: str | None = None) -> str:
    return f"CAST({expr} AS VARCHAR) AS {name or expr}"


MEASURES = f"{num('total_qty')}, {single('avg_sales_price')}, {num('total_discount_value')}"
RAW_COLS = f"product_id, sales_year, sales_week, {MEASURES}, sales_date_weekly_number, {ATTRS}"
FULL = f"{day()}, Forte_rotation, {RAW_COLS}"
STEPS_AHEAD = (1, 2, 3, 4, 12, 26)
W = "OVER (PARTITION BY product_id, split ORDER BY First_day)"


def _fixed(select: str, source: str) -> str:
    return f"{base(source)} SELECT {select} FROM {source}"


def _unpivot(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


SQL: dict[str, str] = {}

SQL["scan_demand"] = _fixed(RAW_COLS, "raw")
NULLS = ", raw_nulls AS (SELECT * REPLACE (CASE WHEN (product_id + sales_week) % 97 <> 0 THEN avg_sales_price END AS avg_sales_price) FROM raw)"
RAW_NAMES = ["product_id", "sales_year", "sales_week", "total_qty", "avg_sales_price", "total_discount_value",
             "sales_date_weekly_number", "is_stock", "etim_class_id", "etim_class", "sis_sub_family_id",
             "sis_sub_family", "sis_group_id", "vendor_id"]
SQL["null_audit"] = (
    base("raw")
    + NULLS
    + ", share AS (SELECT round(100.0 * count(DISTINCT CASE WHEN avg_sales_price IS NULL THEN product_id END)"
    + " / count(DISTINCT product_id), 6) AS pct FROM raw_nulls) "
    + _unpivot(
        f"SELECT '{c}' AS column_name, (SELECT count(*) FROM raw_nulls WHERE {c} IS NULL) AS null_rows,"
        " pct AS pct_products_all_null FROM share"
        for c in RAW_NAMES
    )
)
SQL["drop_nulls"] = base("raw") + NULLS + f" SELECT {RAW_COLS} FROM raw_nulls WHERE avg_sales_price IS NOT NULL"
SQL["cast_measures"] = (
    base("raw")
    + ", texts AS (SELECT product_id, sales_year, sales_week, CAST(total_qty AS VARCHAR) AS q,"
    " CAST(avg_sales_price AS VARCHAR) AS p, CAST(total_discount_value AS VARCHAR) AS d FROM raw)"
    f" SELECT product_id, sales_year, sales_week, {num('CAST(q AS DOUBLE)', 'total_qty')},"
    f" {single('CAST(p AS DOUBLE)', 'avg_sales_price')}, {num('CAST(d AS DOUBLE)', 'total_discount_value')} FROM texts"
)
SQL["cast_rejects"] = (
    base("raw")
    + " SELECT count(*) FILTER (sales_week = 7) AS total_qty, CAST(0 AS BIGINT) AS avg_sales_price,"
    " CAST(0 AS BIGINT) AS total_discount_value FROM raw"
)
SQL["week_first_day"] = base("typed") + f" SELECT DISTINCT sales_year, sales_week, {day()} FROM typed"
SQL["iso_week_parts"] = (
    base("typed")
    + f" SELECT DISTINCT {day()}, CAST(week(First_day) AS INTEGER) AS iso_week,"
    " CAST(year(First_day) AS INTEGER) AS calendar_year FROM typed"
)
SQL["encode_attributes"] = (
    base("prepared")
    + f" SELECT product_id, {day()}, CASE is_stock WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS is_stock_numeric,"
    " CAST(Forte_rotation AS INTEGER) AS FR_numeric,"
    " TRY_CAST(substr(etim_class_id, 3, 6) AS DOUBLE) AS etim_class_numeric FROM prepared"
)
SQL["duplicate_weeks"] = (
    base("typed")
    + f" SELECT product_id, {day()}, count(*) AS n_rows FROM typed GROUP BY product_id, typed.First_day HAVING count(*) > 1"
)
SQL["merge_duplicate_weeks"] = base("merged") + f" SELECT {day()}, {RAW_COLS} FROM merged"
GAP = "DATE '2000-03-06', DATE '2000-03-13', DATE '2001-01-15'"
SQL["calendar_gaps"] = (
    base("typed")
    + f", present AS (SELECT DISTINCT First_day FROM typed WHERE First_day NOT IN ({GAP})),"
    " pairs AS (SELECT First_day AS a, lead(First_day) OVER (ORDER BY First_day) AS b FROM present)"
    f" SELECT {day('a', 'week_before')}, {day('b', 'week_after')}, CAST(b - a AS INTEGER) AS days_apart"
    " FROM pairs WHERE b - a <> 7"
)
SQL["missing_weeks"] = (
    base("typed")
    + f", present AS (SELECT DISTINCT First_day FROM typed WHERE First_day NOT IN ({GAP})),"
    " full_range AS (SELECT CAST(unnest(generate_series(min(First_day), max(First_day), INTERVAL 7 DAY)) AS DATE)"
    f" AS First_day FROM present) SELECT {day()} FROM full_range"
    " WHERE First_day NOT IN (SELECT First_day FROM present)"
)
SQL["repair_missing_weeks"] = (
    base("merged")
    + f", kept AS (SELECT * FROM merged WHERE First_day NOT IN ({GAP})),"
    f" gaps AS (SELECT unnest([{GAP}]) AS gap),"
    " sizes AS (SELECT product_id, count(*) AS n FROM kept GROUP BY 1),"
    " nearest AS (SELECT product_id, gap, n, max(First_day) FILTER (First_day < gap) AS before_day,"
    "   min(First_day) FILTER (First_day > gap) AS after_day, max(First_day) AS newest"
    "   FROM kept JOIN sizes USING (product_id) CROSS JOIN gaps GROUP BY 1, 2, 3),"
    " made AS (SELECT n.product_id, gap, n >= 100 AS big, coalesce(before_day, after_day) AS lo,"
    "   coalesce(after_day, before_day) AS hi, newest FROM nearest n)"
    f" SELECT {day()}, {RAW_COLS} FROM kept UNION ALL"
    f" SELECT {day('gap', 'First_day')}, m.product_id, CAST(year(gap) AS INTEGER), CAST(week(gap) AS INTEGER),"
    f" {num('CASE WHEN big THEN (a.total_qty + b.total_qty) / 2 ELSE 0 END', 'total_qty')},"
    f" {single('CASE WHEN big THEN (a.avg_sales_price + b.avg_sales_price) / 2 ELSE 0 END', 'avg_sales_price')},"
    f" {num('CASE WHEN big THEN (a.total_discount_value + b.total_discount_value) / 2 ELSE 0 END', 'total_discount_value')},"
    " CAST(CASE WHEN big THEN round_even((a.sales_date_weekly_number + b.sales_date_weekly_number) / 2.0, 0)"
    " ELSE 0 END AS BIGINT), c.is_stock, c.etim_class_id, c.etim_class, c.sis_sub_family_id, c.sis_sub_family,"
    " c.sis_group_id, c.vendor_id FROM made m"
    " JOIN kept a ON a.product_id = m.product_id AND a.First_day = lo"
    " JOIN kept b ON b.product_id = m.product_id AND b.First_day = hi"
    " JOIN kept c ON c.product_id = m.product_id AND c.First_day = CASE WHEN big THEN lo ELSE newest END"
)
SQL["repair_edge_gap"] = (
    base("merged")
    + f" SELECT {day('m.First_day', 'First_day')}, count(*) AS n_rows, {num('sum(total_qty)', 'total_qty')} FROM merged m"
    " WHERE First_day > DATE '1995-01-09' GROUP BY m.First_day"
)
SQL["last_n_weeks"] = base("recent") + f" SELECT {day()}, {RAW_COLS} FROM recent"
SQL["rotation_flag"] = base("flagged") + f" SELECT product_id, {day()}, Forte_rotation FROM flagged"
SQL["rotation_summary"] = (
    base("flagged")
    + " SELECT count(DISTINCT product_id) AS products,"
    " count(DISTINCT product_id) FILTER (Forte_rotation) AS high_products,"
    " count(DISTINCT product_id) FILTER (NOT Forte_rotation) AS low_products,"
    " count(DISTINCT product_id) FILTER (n <= 40) AS rare_products FROM flagged"
)
SQL["drop_rare_products"] = (
    base("prepared") + f" SELECT product_id, {day()}, {num('total_qty')}, Forte_rotation FROM prepared"
)
SQL["demand_prepared"] = base("prepared") + f" SELECT {FULL} FROM prepared"

SQL["week_product_grid"] = (
    base("kinds")
    + f" SELECT {day('w.First_day', 'First_day')}, product_id FROM (SELECT DISTINCT First_day FROM prepared) w"
    " CROSS JOIN kinds WHERE NOT Forte_rotation"
)
RANKED = """, zero AS (SELECT First_day, product_id, CAST(0 AS DOUBLE) AS total_qty, CAST(0 AS DOUBLE) AS avg_sales_price,
        CAST(0 AS DOUBLE) AS total_discount_value, 'DATA_C' AS Table_name, CAST(0 AS BIGINT) AS sales_date_weekly_number
        FROM (SELECT DISTINCT First_day FROM prepared) CROSS JOIN kinds WHERE NOT Forte_rotation),
    stacked AS (SELECT * FROM zero UNION ALL SELECT First_day, product_id, total_qty, avg_sales_price,
        total_discount_value, 'DATA_NC', sales_date_weekly_number FROM prepared WHERE NOT Forte_rotation),
    ranked AS (SELECT *, rank() OVER (PARTITION BY First_day, product_id ORDER BY Table_name DESC) AS ranking FROM stacked)"""
SQL["rank_real_over_filler"] = (
    base("kinds")
    + RANKED
    + f" SELECT {day()}, product_id, {MEASURES}, Table_name, sales_date_weekly_number FROM ranked WHERE ranking = 1"
)
WEEKLY = f"product_id, {day()}, Forte_rotation, sales_week, sales_year, {MEASURES}, sales_date_weekly_number"
SQL["fill_low_rotation"] = base("filled") + f" SELECT {WEEKLY} FROM filled WHERE NOT Forte_rotation"
SQL["fill_high_rotation"] = base("filled") + f" SELECT {WEEKLY} FROM filled WHERE Forte_rotation"
SQL["union_completed"] = (
    base("filled")
    + f" SELECT product_id, {day()}, 'true' AS Forte_rotation, sales_week, sales_year, {MEASURES},"
    " sales_date_weekly_number FROM filled WHERE Forte_rotation UNION ALL"
    f" SELECT product_id, {day()}, 'none', -1, -1, {MEASURES}, sales_date_weekly_number"
    " FROM filled WHERE NOT Forte_rotation"
)
SQL["attach_attributes"] = (
    base("completed")
    + f" SELECT product_id, {day()}, {num('total_qty')}, {ATTRS} FROM completed WHERE NOT Forte_rotation"
)
SQL["grid_completeness"] = (
    base("filled")
    + " SELECT Forte_rotation, count(*) AS n_rows, count(DISTINCT product_id) AS products,"
    " (SELECT count(DISTINCT First_day) FROM prepared) AS weeks,"
    " count(*) = count(DISTINCT product_id) * (SELECT count(DISTINCT First_day) FROM prepared) AS is_complete"
    " FROM filled GROUP BY Forte_rotation"
)
SQL["demand_complete"] = base("completed") + f" SELECT {FULL} FROM completed"

SQL["outlier_limits"] = base("prepared") + " " + _unpivot(
    f"SELECT '{c}' AS measure, {single(f'avg({c})', 'mean')}, {single(f'stddev_pop({c})', 'sd')},"
    f" {single(f'avg({c}) - 3 * stddev_pop({c})', 'lower')}, {single(f'avg({c}) + 3 * stddev_pop({c})', 'upper')} FROM prepared"
    for c in ("total_qty", "avg_sales_price", "total_discount_value")
)
SQL["outlier_rows"] = (
    base("limits")
    + f" SELECT product_id, {day()}, {num('total_qty')} FROM completed CROSS JOIN limits WHERE total_qty >= lq"
)
SQL["replace_outliers_qty"] = (
    base("filtered") + f" SELECT product_id, {day()}, {num('total_qty')}, stuck_qty AS all_outliers FROM filtered"
)
SQL["demand_filtered"] = base("filtered") + f" SELECT {FULL} FROM filtered"
SQL["filtered_table"] = SQL["demand_filtered"]

LAGS = ", ".join(
    [num(f"lag(total_qty, {k}) {W}", f"lag_total_qty_{k}") for k in STEPS_AHEAD]
    + [num(f"total_qty - lag(total_qty, {k}) {W}", f"diff_total_qty_{k}") for k in STEPS_AHEAD]
)


def _rolling(k: int) -> str:
    frame = f"OVER (PARTITION BY product_id, split ORDER BY First_day ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return num(f"CASE WHEN count(*) {frame} = {k} THEN avg(total_qty) {frame} END", f"mean_tqs_{k}")


LEADS = ", ".join(num(f"lead(total_qty, {k}) {W}", f"total_qty_next_week_{k}") for k in STEPS_AHEAD)
KEYED = f"product_id, {day()}, split, {num('total_qty')}"
SQL["lag_features"] = base("split") + f" SELECT {KEYED}, {LAGS} FROM split"
SQL["rolling_mean"] = base("split") + f" SELECT {KEYED}, {', '.join(_rolling(k) for k in (4, 12, 26))} FROM split"
SQL["lead_targets"] = base("split") + f" SELECT {KEYED}, {LEADS} FROM split"
P = "OVER (PARTITION BY product_id ORDER BY First_day)"
SQL["first_difference"] = (
    base("filtered")
    + f", d AS (SELECT product_id, First_day, total_qty, total_qty - lag(total_qty) {P} AS diff_total_qty FROM filtered)"
    f" SELECT product_id, {day()}, {num('total_qty')}, {num('diff_total_qty')} FROM d WHERE diff_total_qty IS NOT NULL"
)
NUMBERED = f""", numbered AS (SELECT *, row_number() {P} AS rn, count(*) OVER (PARTITION BY product_id) AS cnt FROM filtered)"""
SQL["invert_difference"] = (
    base("filtered")
    + NUMBERED
    + f" SELECT product_id, CAST(rn - (cnt - 30) AS INTEGER) AS step, {num('total_qty', 'yhat')} FROM numbered WHERE rn > cnt - 30"
)
SQL["date_split"] = (
    base("split")
    + f" SELECT split, count(*) AS n_rows, {day('min(First_day)', 'first')}, {day('max(First_day)', 'last')}"
    " FROM split GROUP BY split"
)
SQL["train_test_split"] = (
    base("filtered")
    + NUMBERED
    + f" SELECT product_id, {day()}, {num('total_qty')}, CAST(rn AS INTEGER) AS pos,"
    " CASE WHEN rn <= floor(0.85::DOUBLE * cnt) THEN 'train' ELSE 'test' END AS part FROM numbered"
)
SQL["train_valid_test_split"] = (
    base("filtered")
    + NUMBERED
    + " SELECT product_id, CASE WHEN rn <= 100 THEN 'train' WHEN rn <= 132 THEN 'valid' ELSE 'test' END AS part,"
    f" count(*) AS n_rows, {num('sum(total_qty)', 'total_qty')} FROM numbered GROUP BY 1, 2"
)
SQL["last_rows_split"] = (
    base("filtered")
    + NUMBERED
    + f" SELECT product_id, CASE WHEN rn > cnt - 30 THEN 'test' ELSE 'train' END AS part, count(*) AS n_rows,"
    f" {day('min(First_day)', 'first')} FROM numbered GROUP BY 1, 2"
)
STATIC = (
    f"{num('total_qty')}, sales_date_weekly_number, sales_week, sales_year, sis_sub_family_id, sis_group_id,"
    " vendor_id, is_stock_numeric, FR_numeric, etim_class_numeric"
)
ONE_STEP = f""", ahead AS (SELECT *, lead(total_qty) {W} AS nxt FROM encoded),
    kept AS (SELECT * FROM ahead WHERE split = 'valid' OR (nxt IS NOT NULL AND is_stock_numeric IS NOT NULL
        AND FR_numeric IS NOT NULL AND etim_class_numeric IS NOT NULL))"""
SQL["features_one_step"] = (
    base("encoded")
    + ONE_STEP
    + f" SELECT product_id, {day()}, split, {STATIC}, {num(f'lag(total_qty) {W}', 'lag_total_qty_1')},"
    f" {num(f'total_qty - lag(total_qty) {W}', 'diff_total_qty_1')}, {_rolling(4)}, {num('nxt', 'total_qty_next_week')} FROM kept"
)
MADE = (
    [f"lag(total_qty, {k}) {W} AS lag_total_qty_{k}" for k in STEPS_AHEAD]
    + [f"total_qty - lag(total_qty, {k}) {W} AS diff_total_qty_{k}" for k in STEPS_AHEAD]
    + [_rolling(k) for k in (4, 12, 26)]
    + [f"lead(total_qty, {k}) {W} AS total_qty_next_week_{k}" for k in STEPS_AHEAD]
)
MADE_NAMES = (
    [f"lag_total_qty_{k}" for k in STEPS_AHEAD]
    + [f"diff_total_qty_{k}" for k in STEPS_AHEAD]
    + [f"mean_tqs_{k}" for k in (4, 12, 26)]
    + [f"total_qty_next_week_{k}" for k in STEPS_AHEAD]
)
SQL["features_multi_step"] = (
    base("encoded")
    + f", made AS (SELECT *, {', '.join(MADE)}, row_number() {W} AS rn,"
    " count(*) OVER (PARTITION BY product_id, split) AS cnt FROM encoded)"
    f" SELECT product_id, {day()}, split, {STATIC}, {', '.join(num(c) for c in MADE_NAMES)} FROM made"
    " WHERE split = 'valid' OR (rn > 26 AND cnt - rn >= 48)"
)
SQL["window_samples"] = (
    base("filtered")
    + NUMBERED
    + ", frames AS (SELECT product_id, rn, cnt, total_qty AS x_first, nth_value(total_qty, 50) OVER f AS x_last,"
    " sum(total_qty) OVER (PARTITION BY product_id ORDER BY First_day ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS x_sum, "
    + ", ".join(f"lead(total_qty, {49 + s}) {P} AS target_{s}" for s in STEPS_AHEAD)
    + " FROM numbered WINDOW f AS (PARTITION BY product_id ORDER BY First_day ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING))"
    f" SELECT product_id, CAST(rn - 1 AS INTEGER) AS i, {num('x_first')}, {num('x_last')}, {num('x_sum')}, "
    + ", ".join(num(f"target_{s}") for s in STEPS_AHEAD)
    + " FROM frames WHERE rn - 1 <= cnt - 50 - 26"
)
SQL["series_arrays"] = (
    base("filtered")
    + f" SELECT product_id, CAST(count(*) AS INTEGER) AS n, {day('min(First_day)', 'first_week')},"
    f" {day('max(First_day)', 'last_week')}, {num('arg_min(total_qty, First_day)', 'y_first')},"
    f" {num('arg_max(total_qty, First_day)', 'y_last')}, {num('sum(total_qty)', 'y_sum')} FROM filtered GROUP BY product_id"
)
SQL["pivot_week_group"] = (
    base("filtered")
    + ", sums AS (SELECT First_day, sis_group_id, sum(total_qty) AS total_qty FROM filtered GROUP BY 1, 2),"
    " cells AS (SELECT * FROM (SELECT DISTINCT First_day FROM filtered) CROSS JOIN (SELECT DISTINCT sis_group_id FROM filtered))"
    f" SELECT {day('c.First_day', 'First_day')}, CAST(c.sis_group_id AS VARCHAR) AS grp, {num('s.total_qty', 'total_qty')}"
    " FROM cells c LEFT JOIN sums s ON s.First_day = c.First_day AND s.sis_group_id = c.sis_group_id"
)
IMPUTED = {"lag_total_qty_1": f"lag(total_qty) {W}", "diff_total_qty_1": f"total_qty - lag(total_qty) {W}"}
FRAME4 = "OVER (PARTITION BY product_id, split ORDER BY First_day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
IMPUTED["mean_tqs_4"] = f"CASE WHEN count(*) {FRAME4} = 4 THEN avg(total_qty) {FRAME4} END"
SQL["impute_mean"] = (
    base("encoded")
    + ONE_STEP
    + f", made AS (SELECT product_id, First_day, split, {', '.join(f'{e} AS {c}' for c, e in IMPUTED.items())} FROM kept),"
    f" means AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in IMPUTED)} FROM made WHERE split = 'train')"
    f" SELECT product_id, {day()}, {', '.join(num(f'coalesce({c}, m_{c})', c) for c in IMPUTED)} FROM made CROSS JOIN means"
)


def _scaled(by: str, value: str) -> str:
    return (
        base("filtered")
        + f", s AS (SELECT {by}, avg(total_qty) AS mu, CASE WHEN stddev_pop(total_qty) = 0 THEN 1"
        f" ELSE stddev_pop(total_qty) END AS sd FROM filtered GROUP BY {by})"
        f" SELECT product_id, {day()}, {value} FROM filtered JOIN s USING ({by})"
    )


SCALED = f"{num('(total_qty - mu) / sd', 'total_qty')}, {num('mu')}, {num('sd')}"
SQL["scale_by_group"] = _scaled("sis_group_id", SCALED)
SQL["scale_by_product"] = _scaled("product_id", SCALED)
SQL["unscale_by_product"] = base("filtered") + f" SELECT product_id, {day()}, {num('total_qty')} FROM filtered"

COV = "stddev_samp(total_qty) / nullif(avg(total_qty), 0)"
SQL["demand_cov"] = (
    base("filtered")
    + f" SELECT product_id, {num(COV, 'cov')}, CASE WHEN {COV} >= 1 THEN 'high' WHEN {COV} < 1 THEN 'low' END AS cov_class"
    " FROM filtered GROUP BY product_id"
)
FULLER = f""", pairs AS (SELECT product_id, lag(total_qty) {P} AS x, total_qty - lag(total_qty) {P} AS dx FROM fuller_input),
    sums AS (SELECT product_id, count(*) AS n_obs, regr_slope(dx, x) AS b, regr_sxx(dx, x) AS sxx,
        regr_syy(dx, x) - regr_sxy(dx, x) * regr_sxy(dx, x) / nullif(regr_sxx(dx, x), 0) AS rss
        FROM pairs WHERE x IS NOT NULL GROUP BY product_id),
    tested AS (SELECT product_id, n_obs, b / nullif(sqrt(rss / nullif((n_obs - 2) * sxx, 0)), 0) AS stat FROM sums),
    quantile AS (SELECT *, CASE WHEN stat <= -1.61 THEN 2.1659 + 1.4412 * stat + 0.038269 * stat ** 2
        ELSE 1.7339 + 0.93202 * stat - 0.12745 * stat ** 2 - 0.010368 * stat ** 3 END AS z FROM tested),
    fuller AS (SELECT *, coalesce(CASE WHEN stat < -18.83 THEN true WHEN stat > 2.74 THEN false
        ELSE z < -1.6448536269514722 END, false) AS stationary FROM quantile)"""
SQL["dickey_fuller_lag0"] = (
    base("filtered")
    + FULLER.replace("fuller_input", "filtered")
    + f" SELECT product_id, n_obs, {num('stat')}, {num('z')}, stationary, CASE WHEN stationary THEN 0 ELSE 1 END AS d FROM fuller"
)

MEASURES4 = ("total_qty", "avg_sales_price", "total_discount_value", "sales_date_weekly_number")
SQL["describe_measures"] = base("filtered") + " " + _unpivot(
    f"SELECT '{c}' AS measure, {single(f'avg({c})', 'mean')}, {single(f'max({c})', 'max')}, {single(f'min({c})', 'min')} FROM filtered"
    for c in MEASURES4
)
ATTR_NAMES = ("product_id", "is_stock", "etim_class_id", "etim_class", "sis_sub_family_id", "sis_sub_family",
              "sis_group_id", "vendor_id")
SQL["attribute_hierarchy"] = base("filtered") + " " + _unpivot(
    f"SELECT '{a}' AS attribute, '{b}' AS dependent, count(*) AS n_values, max(n) AS max_dependents, max(n) <= 1 AS determines"
    f" FROM (SELECT {a}, count(DISTINCT {b}) AS n FROM filtered GROUP BY {a})"
    for a in ATTR_NAMES
    for b in ATTR_NAMES
    if a != b
)
SQL["measure_correlation"] = base("filtered") + " " + _unpivot(
    f"SELECT '{a}' AS measure_a, '{b}' AS measure_b, {num(f'corr({a}, {b})', 'corr')} FROM filtered"
    for i, a in enumerate(MEASURES4)
    for b in MEASURES4[i + 1 :]
)
SQL["density_grid"] = (
    base("filtered")
    + ", st AS (SELECT count(*) AS n, stddev_samp(total_qty) * count(*) ** (-0.2) AS h,"
    " min(total_qty) - (max(total_qty) - min(total_qty)) / 2 AS lo, (max(total_qty) - min(total_qty)) * 2 / 99 AS gap FROM filtered)"
    f" SELECT CAST(p.point AS INTEGER) AS point, {num('any_value(lo + p.point * gap)', 'value')},"
    f" {num('sum(exp(-(((total_qty - (lo + p.point * gap)) / h) ** 2) / 2)) / any_value(n * h * sqrt(2 * pi()))', 'density')}"
    " FROM filtered CROSS JOIN st CROSS JOIN (SELECT unnest(range(100)) AS point) p GROUP BY p.point"
)
SQL["density_binned"] = (
    base("filtered")
    + ", st AS (SELECT count(*) AS n, stddev_samp(total_qty) * count(*) ** (-0.2) AS h, min(total_qty) AS least,"
    " (max(total_qty) - min(total_qty)) / 512 AS d, min(total_qty) - (max(total_qty) - min(total_qty)) / 2 AS lo,"
    " (max(total_qty) - min(total_qty)) * 2 / 99 AS gap FROM filtered),"
    " spot AS (SELECT (total_qty - least) / d AS v FROM filtered CROSS JOIN st),"
    " low AS (SELECT v, CASE WHEN v >= 512 THEN 511 ELSE floor(v) END AS mark FROM spot),"
    " marks AS (SELECT mark, sum(w) AS w FROM (SELECT mark, 1 - (v - mark) AS w FROM low UNION ALL SELECT mark + 1, v - mark FROM low) GROUP BY mark)"
    f" SELECT CAST(p.point AS INTEGER) AS point, {num('any_value(lo + p.point * gap)', 'value')},"
    f" {num('sum(w * exp(-(((least + mark * d - (lo + p.point * gap)) / h) ** 2) / 2)) / any_value(n * h * sqrt(2 * pi()))', 'density')},"
    f" {num('any_value(d * d / 8 / (h * h * h * sqrt(2 * pi())))', 'error_bound')}"
    " FROM marks CROSS JOIN st CROSS JOIN (SELECT unnest(range(100)) AS point) p GROUP BY p.point"
)
SQL["seasonal_index"] = (
    base("filtered")
    + f" SELECT CAST(week(First_day) AS INTEGER) AS iso_week, {num('avg(total_qty)', 'mean')}, count(*) AS n,"
    f" {num('avg(total_qty) / (SELECT avg(total_qty) FROM filtered)', 'seasonal_index')} FROM filtered GROUP BY 1"
)
SQL["autocorrelation"] = (
    base("filtered")
    + f", pairs AS (SELECT product_id, total_qty AS x, lag(total_qty, 52) {P} AS z FROM filtered)"
    f" SELECT product_id, count(*) AS pairs, {num('CASE WHEN max(x) > min(x) AND max(z) > min(z) THEN corr(x, z) END', 'autocorrelation')}"
    " FROM pairs WHERE z IS NOT NULL GROUP BY product_id"
)

# --- forecasts and scores ------------------------------------------------------------------------------

VALID_ORDER = "OVER (PARTITION BY product_id ORDER BY First_day)"
NAIVE = (
    ", valid AS (SELECT * FROM split WHERE split = 'valid'), naive AS ("
    + " UNION ALL ".join(
        f"SELECT 'naive' AS model, product_id, sis_group_id, First_day, {k} AS step,"
        f" lead(total_qty, {k}) {VALID_ORDER} AS y, total_qty AS yhat FROM valid"
        for k in STEPS_AHEAD
    )
    + "), naive_known AS (SELECT * FROM naive WHERE y IS NOT NULL)"
)
SQL["naive_forecast"] = (
    base("split")
    + NAIVE
    + f" SELECT model, product_id, sis_group_id, {day()}, step, {num('y')}, {num('yhat')} FROM naive_known"
)
MEAN_OR_LAST = (
    NUMBERED
    + FULLER.replace("fuller_input", "filtered")
    + f""", varied AS (SELECT product_id, {COV} AS cov FROM filtered GROUP BY product_id),
    cuts AS (SELECT *, floor(0.85::DOUBLE * cnt) AS cut FROM numbered),
    levels AS (SELECT product_id, avg(total_qty) AS mean, arg_max(total_qty, rn) AS last_value
        FROM cuts WHERE rn <= cut GROUP BY product_id),
    mean_or_last AS (SELECT 'arima_mean_or_last' AS model, product_id, sis_group_id, CAST(rn - cut AS INTEGER) AS step,
        total_qty AS y, CASE WHEN stationary THEN mean ELSE last_value END AS yhat
        FROM cuts JOIN levels USING (product_id) JOIN varied USING (product_id) JOIN fuller USING (product_id)
        WHERE cov >= 1 AND rn > cut AND rn <= cut + 24)"""
)
SQL["arima_mean_or_last"] = (
    base("split")
    + MEAN_OR_LAST
    + f" SELECT model, product_id, sis_group_id, step, {num('y')}, {num('yhat')} FROM mean_or_last"
)
RMSE = "sqrt(avg((y - yhat) * (y - yhat)))"
WMAPE = "sum(abs(y - yhat)) / nullif(sum(abs(y)), 0)"
SCORES = f"{num(RMSE, 'rmse')}, {num(WMAPE, 'wmape')}, count(*) AS n"


def _levels(source: str, where: str = "true") -> str:
    return (
        f"SELECT model, CAST(sis_group_id AS VARCHAR) AS grp, step, {RMSE} AS rmse, {WMAPE} AS wmape, count(*) AS n"
        f" FROM {source} WHERE {where} GROUP BY 1, 2, 3 UNION ALL"
        f" SELECT model, 'total', step, {RMSE}, {WMAPE}, count(*) FROM {source} WHERE {where} GROUP BY 1, 3"
    )


SQL["metrics_total"] = base("split") + NAIVE + f" SELECT {SCORES} FROM naive_known"
SQL["metrics_by_step"] = base("split") + NAIVE + f" SELECT step, {SCORES} FROM naive_known GROUP BY step"
SQL["metrics_by_group_step"] = (
    base("split")
    + NAIVE
    + f", levels_ AS ({_levels('naive_known')}) SELECT model, grp, step, {num('rmse')}, {num('wmape')}, n FROM levels_"
)
SQL["metrics_by_product"] = (
    base("split") + MEAN_OR_LAST + f" SELECT product_id, {SCORES} FROM mean_or_last GROUP BY product_id"
)
SQL["step_group_table"] = (
    base("split")
    + NAIVE
    + f", levels_ AS ({_levels('naive_known')}),"
    " cells AS (SELECT * FROM (SELECT DISTINCT step FROM levels_) CROSS JOIN (SELECT DISTINCT grp FROM levels_))"
    f" SELECT 'step_' || c.step AS step, c.grp, {num('l.wmape', 'wmape')}"
    " FROM cells c LEFT JOIN levels_ l ON l.step = c.step AND l.grp = c.grp"
)
SQL["aligned_actuals"] = (
    base("filtered")
    + NUMBERED
    + ", ends AS (SELECT product_id, total_qty AS yhat FROM numbered WHERE rn = 132)"
    f" SELECT product_id, sis_group_id, CAST(rn - 132 AS INTEGER) AS step, {num('total_qty', 'y')}, {num('yhat')}"
    " FROM numbered JOIN ends USING (product_id) WHERE rn - 132 IN (1, 2, 3, 4, 12, 24)"
)
SQL["model_leaderboard"] = (
    base("split")
    + NAIVE
    + MEAN_OR_LAST
    + ", stacked AS (SELECT model, sis_group_id, step, y, yhat FROM naive_known UNION ALL"
    " SELECT model, sis_group_id, step, y, yhat FROM mean_or_last),"
    f" levels_ AS ({_levels('stacked', 'step IN (1, 2, 3, 4, 12, 24, 26)')})"
    f" SELECT model, grp, step, {num('rmse')}, {num('wmape')}, n,"
    " CAST(rank() OVER (PARTITION BY grp, step ORDER BY rmse) AS INTEGER) AS place FROM levels_"
)

# --- Gram matrices -------------------------------------------------------------------------------------


def _ridge_rows(chunk: int) -> str:
    cols = ["1.0"] + [f"lag(total_qty, {k}) {P}" for k in (1, 2, 3, 4, 12, 26, 52)]
    cols += ["CAST(sales_year AS DOUBLE)", "CAST(sales_week AS DOUBLE)"]
    cols += [f"lead(total_qty, {k}) {P}" for k in range(chunk)]
    return (
        f"SELECT {chunk} AS design, product_id, t, unnest(z) AS v, CAST(generate_subscripts(z, 1) - 1 AS INTEGER) AS j"
        f" FROM (SELECT product_id, rn - 1 AS t, [{', '.join(cols)}] AS z FROM numbered)"
        f" WHERE t >= 52 AND t <= 100 - {chunk}"
    )


SQL["ridge_gram"] = (
    base("filtered")
    + NUMBERED
    + f", cells AS ({' UNION ALL '.join(_ridge_rows(c) for c in (1, 2, 6, 12, 26))})"
    f" SELECT a.design, a.j AS i, b.j AS j, {num('sum(a.v * b.v)', 's')} FROM cells a JOIN cells b"
    " ON a.design = b.design AND a.product_id = b.product_id AND a.t = b.t AND a.j <= b.j GROUP BY 1, 2, 3"
)
SQL["var_gram"] = (
    base("filtered")
    + f""", s AS (SELECT product_id, avg(total_qty) AS mu, CASE WHEN stddev_pop(total_qty) = 0 THEN 1
        ELSE stddev_pop(total_qty) END AS sd FROM filtered GROUP BY 1),
    z AS (SELECT product_id, sis_group_id, CAST(row_number() {P} - 2 AS INTEGER) AS t,
        (total_qty - lag(total_qty) {P}) / sd AS x, count(*) OVER (PARTITION BY product_id) AS cnt
        FROM filtered JOIN s USING (product_id)),
    kept AS (SELECT * FROM z WHERE t BETWEEN 0 AND cnt - 30 - 2)
    SELECT a.sis_group_id, a.t AS i, b.t AS j, round(sum(a.x * b.x), 4) + 0.0::DOUBLE AS s
    FROM kept a JOIN kept b ON a.product_id = b.product_id AND a.t <= b.t GROUP BY 1, 2, 3"""
)
WINDOW_CELLS = ", ".join(
    ["1.0"]
    + [f"lead(x, {k}) {P}" for k in range(50)]
    + [f"lead(x, {49 + k}) {P}" for k in STEPS_AHEAD]
)
SQL["window_gram"] = (
    base("filtered")
    + f""", s AS (SELECT product_id, avg(total_qty) AS mu, CASE WHEN stddev_pop(total_qty) = 0 THEN 1
        ELSE stddev_pop(total_qty) END AS sd FROM filtered GROUP BY 1),
    z AS (SELECT product_id, sis_group_id, First_day, (total_qty - mu) / sd AS x FROM filtered JOIN s USING (product_id)),
    wide AS (SELECT product_id, sis_group_id, row_number() {P} - 1 AS w, count(*) OVER (PARTITION BY product_id) AS cnt, [{WINDOW_CELLS}] AS v FROM z),
    cells AS (SELECT product_id, sis_group_id, w, unnest(v) AS v, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS j
        FROM wide WHERE w < floor(0.85::DOUBLE * (cnt - 75)))
    SELECT a.sis_group_id, a.j AS i, b.j AS j, round(sum(a.v * b.v), 3) + 0.0::DOUBLE AS s
    FROM cells a JOIN cells b ON a.product_id = b.product_id AND a.w = b.w AND a.j <= b.j GROUP BY 1, 2, 3"""
)

# --- actual values of the test weeks ---------------------------------------------------------------------


def _actuals(model: str, start: str, steps: str, scope: str = "-") -> str:
    """Rows after position ``start`` as steps 1, 2, ..."""
    return (
        f"SELECT '{model}' AS model, '{scope}' AS scope, product_id, sis_group_id, CAST(rn - {start} AS INTEGER) AS step,"
        f" {num('total_qty', 'y')} FROM numbered JOIN varied USING (product_id) WHERE rn - {start} {steps}"
    )


VARIED = f", varied AS (SELECT product_id, {COV} AS cov FROM filtered GROUP BY product_id) "
ALIGNED = _unpivot(
    [
        _actuals("arima", "floor(0.85::DOUBLE * cnt)", "BETWEEN 1 AND 24 AND cov IS NOT NULL"),
        _actuals("ridge", "132", "BETWEEN 1 AND 26"),
        _actuals("var", "(cnt - 30)", "BETWEEN 1 AND 30"),
        _actuals("window", "(cnt - 26)", "IN (1, 2, 3, 4, 12, 26)", "group"),
        _actuals("window", "(cnt - 26)", "IN (1, 2, 3, 4, 12, 26)", "total"),
    ]
)
SQL["forecast_alignment"] = base("filtered") + NUMBERED + VARIED + ALIGNED
SQL["forecast_coverage"] = (
    base("filtered")
    + NUMBERED
    + VARIED
    + f", aligned AS ({ALIGNED}) SELECT model, scope, product_id, count(*) AS n_rows FROM aligned GROUP BY 1, 2, 3"
)

# --- models small enough for a closed form ------------------------------------------------------------------

STANDARD = """, s AS (SELECT product_id, avg(total_qty) AS mu, CASE WHEN stddev_pop(total_qty) = 0 THEN 1
        ELSE stddev_pop(total_qty) END AS sd FROM filtered GROUP BY 1)"""
SQL["window_one"] = (
    base("filtered")
    + NUMBERED
    + STANDARD
    + f""", z AS (SELECT product_id, sis_group_id, rn, cnt, total_qty, mu, sd, (total_qty - mu) / sd AS x,
        (lead(total_qty) {P} - mu) / sd AS nx, lead(total_qty) {P} AS y FROM numbered JOIN s USING (product_id)),
    train AS (SELECT * FROM z WHERE rn <= floor(0.85::DOUBLE * (cnt - 1))),
    line AS (SELECT 'group' AS scope, sis_group_id AS grp, regr_slope(nx, x) AS b, regr_intercept(nx, x) AS a FROM train GROUP BY sis_group_id
        UNION ALL SELECT 'total', NULL, regr_slope(nx, x), regr_intercept(nx, x) FROM train)
    SELECT 'window' AS model, scope, product_id, sis_group_id, 1 AS step, {num('y')},
        {num('greatest((a + b * x) * sd + mu, 0)', 'yhat')}
    FROM z JOIN line ON grp = sis_group_id OR grp IS NULL WHERE rn = cnt - 1"""
)
SQL["var_single"] = (
    base("filtered")
    + NUMBERED
    + f""", diffs AS (SELECT product_id, rn, cnt, total_qty - lag(total_qty) {P} AS x FROM numbered),
    pairs AS (SELECT product_id, rn, cnt, x, lag(x) {P.replace("First_day", "rn")} AS z FROM diffs),
    line AS (SELECT product_id, regr_slope(x, z) AS b, regr_intercept(x, z) AS a FROM pairs WHERE rn <= cnt - 30 GROUP BY 1),
    ends AS (SELECT product_id, total_qty AS last_value, x AS last_x FROM numbered JOIN diffs USING (product_id, rn, cnt)
        WHERE rn = cnt - 30),
    made AS (SELECT product_id, CAST(step AS INTEGER) AS step,
        last_value + sum(b ** step * last_x + a * (1 - b ** step) / (1 - b)) OVER (PARTITION BY product_id ORDER BY step) AS yhat
        FROM ends JOIN line USING (product_id) CROSS JOIN (SELECT unnest(range(1, 31)) AS step))
    SELECT 'var' AS model, product_id, product_id AS sis_group_id, step, {num('total_qty', 'y')}, {num('yhat')}
    FROM made JOIN numbered USING (product_id) WHERE rn = cnt - 30 + step"""
)
# The first ten values only feed the long autoregression.
AR1 = (
    base("filtered")
    + NUMBERED
    + VARIED
    + f""", known AS (SELECT product_id, rn, total_qty, lag(total_qty) {P} AS before, floor(0.85::DOUBLE * cnt) AS cut
        FROM numbered JOIN varied USING (product_id) WHERE cov < 1),
    u AS (SELECT product_id, 0 AS d, rn AS t, total_qty AS x FROM known WHERE rn <= cut
        UNION ALL SELECT product_id, 1, rn - 1, total_qty - before FROM known WHERE rn <= cut AND rn > 1),
    pairs AS (SELECT *, lag(x) OVER (PARTITION BY product_id, d ORDER BY t) AS z FROM u),
    fit AS (SELECT product_id, d, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS rss0, regr_slope(x, z) AS b,
        regr_intercept(x, z) AS a, regr_syy(x, z) - regr_sxy(x, z) * regr_sxy(x, z) / regr_sxx(x, z) AS rss1
        FROM pairs WHERE t > 10 GROUP BY 1, 2),
    rated AS (SELECT *, n * ln(rss0 / n) + n * (n + 1) / (n - 3) AS aicc0,
        CASE WHEN abs(b) < 0.999 THEN n * ln(rss1 / n) + n * (n + 2) / (n - 4) ELSE 'inf'::DOUBLE END AS aicc1 FROM fit)"""
)
SQL["arima_order"] = (
    AR1 + f" SELECT product_id, CAST(aicc1 < aicc0 AS INTEGER) AS p, d, 0 AS q, {num('least(aicc0, aicc1)', 'aicc')} FROM rated"
)
AR1_LEVELS = (
    AR1
    + f""", model AS (SELECT product_id, d, aicc1 < aicc0 AS ar, CASE WHEN aicc1 < aicc0 THEN b ELSE 0 END AS b,
        CASE WHEN aicc1 < aicc0 THEN a ELSE mean END AS a FROM rated),
    ends AS (SELECT product_id, d, arg_max(x, t) AS last_x FROM u GROUP BY 1, 2),
    made AS (SELECT product_id, d, ar, CAST(step AS INTEGER) AS step, b ** step * last_x + a * (1 - b ** step) / (1 - b) AS v
        FROM model JOIN ends USING (product_id, d) CROSS JOIN (SELECT unnest(range(1, 25)) AS step)),
    level AS (SELECT product_id, d, ar, step, CASE d WHEN 0 THEN v
        ELSE total_qty + sum(v) OVER (PARTITION BY product_id, d ORDER BY step) END AS yhat
        FROM made JOIN known USING (product_id) WHERE rn = cut),
    ar1 AS (SELECT l.product_id, sis_group_id, step, d, total_qty AS y, yhat, CASE WHEN ar THEN '1,' ELSE '0,' END || d || ',0' AS "order"
        FROM level l JOIN numbered k ON k.product_id = l.product_id AND rn = floor(0.85::DOUBLE * cnt) + step)"""
)
SQL["arima_ar1"] = (
    AR1_LEVELS + f" SELECT 'arima_search' AS model, product_id, sis_group_id, step, d, {num('y')}, {num('yhat')}, \"order\" FROM ar1"
)
SQL["metrics_by_product_search"] = AR1_LEVELS + f" SELECT product_id, d, {SCORES} FROM ar1 GROUP BY product_id, d"
# All four start after row cnt - 26 and meet in the products with COV >= 1.
SQL["shared_leaderboard"] = (
    base("split")
    + NUMBERED
    + STANDARD
    + FULLER.replace("fuller_input", "filtered").replace("pairs", "fuller_pairs")
    + f""", varied AS (SELECT product_id FROM filtered GROUP BY product_id HAVING {COV} >= 1),
    k AS (SELECT * FROM numbered JOIN varied USING (product_id)),
    steps AS (SELECT unnest([1, 2, 3, 4, 12, 26]) AS step),
    actual AS (SELECT product_id, sis_group_id, step, total_qty AS y FROM k JOIN steps ON rn = cnt - 26 + step),
    ends AS (SELECT product_id, total_qty AS last_value FROM k WHERE rn = cnt - 26),
    means AS (SELECT product_id, avg(total_qty) AS mean FROM k WHERE rn <= cnt - 26 GROUP BY 1),
    diffs AS (SELECT product_id, rn, cnt, total_qty - lag(total_qty) {P} AS x FROM k),
    pairs AS (SELECT product_id, rn, cnt, x, lag(x) {P.replace("First_day", "rn")} AS z FROM diffs),
    line AS (SELECT product_id, regr_slope(x, z) AS b, regr_intercept(x, z) AS a, arg_max(x, rn) AS last_x
        FROM pairs WHERE rn <= cnt - 26 GROUP BY 1),
    moves AS (SELECT product_id, h, sum(b ** h * last_x + a * (1 - b ** h) / (1 - b)) OVER (PARTITION BY product_id ORDER BY h) AS move
        FROM line CROSS JOIN (SELECT unnest(range(1, 27)) AS h)),
    z AS (SELECT product_id, sis_group_id, rn, cnt, (total_qty - mu) / sd AS x, mu, sd FROM numbered JOIN s USING (product_id)),
    fit AS (SELECT l.sis_group_id, step, regr_slope(r.x, l.x) AS b, regr_intercept(r.x, l.x) AS a
        FROM z l CROSS JOIN steps JOIN z r ON r.product_id = l.product_id AND r.rn = l.rn + step
        WHERE l.rn <= floor(0.85::DOUBLE * (l.cnt - 26)) GROUP BY ALL),
    every AS (SELECT step, regr_slope(r.x, l.x) AS b, regr_intercept(r.x, l.x) AS a
        FROM z l CROSS JOIN steps JOIN z r ON r.product_id = l.product_id AND r.rn = l.rn + step
        WHERE l.rn <= floor(0.85::DOUBLE * (l.cnt - 26)) GROUP BY ALL),
    made AS (
        SELECT 'naive' AS model, 'both' AS scope, a.*, last_value AS yhat FROM actual a JOIN ends USING (product_id)
        UNION ALL SELECT 'arima_mean_or_last', 'both', a.*, CASE WHEN stationary THEN mean ELSE last_value END
            FROM actual a JOIN ends USING (product_id) JOIN means USING (product_id) JOIN fuller USING (product_id)
        UNION ALL SELECT 'var', 'both', a.*, last_value + move FROM actual a JOIN ends USING (product_id) JOIN moves ON moves.product_id = a.product_id AND h = step
        UNION ALL SELECT 'window', 'group', a.*, greatest((f.a + f.b * x) * sd + mu, 0)
            FROM actual a JOIN fit f ON f.sis_group_id = a.sis_group_id AND f.step = a.step JOIN z ON z.product_id = a.product_id AND rn = cnt - 26
        UNION ALL SELECT 'window', 'total', a.*, greatest((f.a + f.b * x) * sd + mu, 0)
            FROM actual a JOIN every f ON f.step = a.step JOIN z ON z.product_id = a.product_id AND rn = cnt - 26),
    levels_ AS (SELECT model, CAST(sis_group_id AS VARCHAR) AS grp, step, {RMSE} AS rmse, {WMAPE} AS wmape, count(*) AS n
            FROM made WHERE scope <> 'total' GROUP BY 1, 2, 3
        UNION ALL SELECT model, 'total', step, {RMSE}, {WMAPE}, count(*) FROM made WHERE scope <> 'group' GROUP BY 1, 3)
    SELECT model, grp, step, {num('rmse')}, {num('wmape')}, n,
        CAST(rank() OVER (PARTITION BY grp, step ORDER BY rmse) AS INTEGER) AS place FROM levels_"""
)
SQL["forest_alignment"] = (
    base("split")
    + NAIVE
    + f" SELECT scope, product_id, sis_group_id, {day()}, step, {num('y')}"
    " FROM naive_known CROSS JOIN (SELECT unnest(['group', 'total']) AS scope)"
)
