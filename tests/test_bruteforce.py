"""Random frames: the whole preparation against plain loops over dictionaries."""

import math
import random
from dataclasses import replace

import pytest
from frames import ATTRS, MONDAY, monday

from weekloom.config import MEASURES, ForecastConfig
from weekloom.operators.complete import complete
from weekloom.operators.outliers import replace_outliers, upper_limits
from weekloom.plans.preparation import prepare
from weekloom.sources.tables import DEMAND_SCHEMA

CFG = ForecastConfig(min_rotation=3, keep_weeks=20, high_rotation_weeks=10, gap_neighbour_weeks=8, sigma=1.5)
WEEKS = 30


def random_rows(seed):
    rng = random.Random(seed)
    holes = set(rng.sample(range(3, WEEKS - 3), 3))
    holes |= {1} if seed % 2 else set()  # isolates the first week
    rows = []
    for product in range(1, 9):
        density = rng.choice([0.15, 0.4, 0.7, 0.95])
        for week in range(WEEKS):
            if week in holes or (rng.random() > density and week not in (0, WEEKS - 1)):
                continue
            for _ in range(1 + (rng.random() < 0.1)):
                qty = float(rng.choice([1, 2, 3, 5, 8, 40]))
                rows.append((product, week, qty, qty * rng.choice([1.0, 2.0]), rng.random(), rng.randint(1, 6)))
    return rows


def spark_rows(spark, rows):
    out = []
    for product, week, qty, price, discount, count in rows:
        day = monday(week)  # 2020 starts on a Wednesday: its week 2 begins on January 6
        out.append(
            {
                "product_id": product,
                "sales_year": 2020,
                "sales_week": week + 2,
                "total_qty": qty,
                "avg_sales_price": price,
                "total_discount_value": discount,
                "sales_date_weekly_number": count,
                **ATTRS,
            }
        )
        assert day.year == 2020
    return spark.createDataFrame(out, DEMAND_SCHEMA)


def mean_fill(lo, hi):
    lo, hi = lo or hi, hi or lo
    made = [(a + b) / 2 for a, b in zip(lo[:3], hi[:3])]
    return (*made, round((lo[3] + hi[3]) / 2))


def nearest(known, week):
    before = [w for w in known if w < week]
    after = [w for w in known if w > week]
    return (known[max(before)] if before else None), (known[min(after)] if after else None)


def plain(rows, cfg):
    """(prepared, complete, filtered), each {product: {week: (qty, price, discount, count)}}."""
    cells = {}
    for product, week, *values in rows:
        cells.setdefault(product, {}).setdefault(week, []).append(values)
    merged = {
        p: {
            w: (sum(v[0] for v in vs), sum(v[1] for v in vs) / len(vs), sum(v[2] for v in vs), sum(v[3] for v in vs))
            for w, vs in weeks.items()
        }
        for p, weeks in cells.items()
    }
    present = sorted({w for weeks in merged.values() for w in weeks})
    if present[1] - present[0] > 1:
        first = present[1]
    else:
        first = present[0]
    last = present[-2] if present[-1] - present[-2] > 1 else present[-1]
    missing = [w for w in range(first, last + 1) if w not in present]
    prepared = {}
    for p, weeks in merged.items():
        kept = {w: v for w, v in weeks.items() if first <= w <= last}
        if not kept:
            continue
        made = {
            w: mean_fill(*nearest(kept, w)) if len(kept) >= cfg.gap_neighbour_weeks else (0.0, 0.0, 0.0, 0)
            for w in missing
        }
        newest = {w: v for w, v in {**kept, **made}.items() if w > last - cfg.keep_weeks}
        if len(newest) > cfg.min_rotation:
            prepared[p] = newest
    lo = min(w for weeks in prepared.values() for w in weeks)
    hi = max(w for weeks in prepared.values() for w in weeks)
    full = {}
    for p, weeks in prepared.items():
        high = len(weeks) > cfg.high_rotation_weeks
        full[p] = {
            w: weeks.get(w) or (mean_fill(*nearest(weeks, w)) if high else (0.0, 0.0, 0.0, 0))
            for w in range(lo, hi + 1)
        }
    limits = []
    for i in range(3):
        values = [v[i] for weeks in prepared.values() for v in weeks.values()]
        mean = sum(values) / len(values)
        limits.append(mean + cfg.sigma * math.sqrt(sum((x - mean) ** 2 for x in values) / len(values)))
    clear = {}
    for p, weeks in full.items():
        clear[p] = {}
        for w, v in weeks.items():
            new = list(v)
            for i in range(3):
                if v[i] >= limits[i]:
                    normal = {k: x[i] for k, x in weeks.items() if x[i] < limits[i]}
                    if normal:
                        before = [k for k in normal if k < w]
                        after = [k for k in normal if k > w]
                        around = [normal[max(before)]] if before else []
                        around += [normal[min(after)]] if after else []
                        new[i] = sum(around) / len(around)
            clear[p][w] = tuple(new)
    return prepared, full, clear


def flat(tables):
    return {(p, w): v for p, weeks in tables.items() for w, v in weeks.items()}


def collected(df):
    return {
        (r["product_id"], (r["First_day"] - MONDAY).days // 7): (*(r[m] for m in MEASURES), r["sales_date_weekly_number"])
        for r in df.collect()
    }


def same(got, want):
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9), key


@pytest.mark.parametrize("seed", range(4))
def test_preparation_equals_plain_loops(spark, seed):
    rows = random_rows(seed)
    cfg = replace(CFG, min_rotation=3 + seed)
    prepared, full, clear = plain(rows, cfg)
    base = prepare(spark_rows(spark, rows), cfg).cache()
    same(collected(base), flat(prepared))
    high = {p for p, weeks in prepared.items() if len(weeks) > cfg.high_rotation_weeks}
    assert {r[0] for r in base.where("Forte_rotation").select("product_id").distinct().collect()} == high
    done = complete(base)
    same(collected(done), flat(full))
    out = replace_outliers(done, upper_limits(base, cfg))
    same(collected(out), flat(clear))
