"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from weekloom.checks.inputs import CFG
from weekloom.checks.queries import REGISTRY
from weekloom.models.arima import forecast_arima
from weekloom.models.forest import forecast_forest, search_forest
from weekloom.models.ridge import search_ridge
from weekloom.models.var import forecast_var
from weekloom.models.window import forecast_window
from weekloom.operators.features import multi_step_features
from weekloom.plans.preparation import demand_complete, demand_filtered
from weekloom.session import local_session, stage
from weekloom.sources.lineitem import raw_demand


def run(df) -> None:
    """Compute every column of every row without collecting."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)

    # Products are suppliers here: a thousand incomplete series at sf0.1. The raw weekly table is
    # an input of preparation, so it is written once.
    table = None

    def raw():
        nonlocal table
        table = stage(raw_demand(spark, sf_dir, key="supplier"), "bench-raw")

    raw()
    run(demand_complete(table, CFG))  # warm-up: JVM and code generation
    history = None

    def filtered():
        nonlocal history
        history = stage(demand_filtered(table, CFG), "bench")

    work = {
        "scan_demand": lambda: run(REGISTRY["scan_demand"](spark, sf_dir)),
        "raw_demand": raw,
        "demand_complete": lambda: run(demand_complete(table, CFG)),
        "demand_filtered": filtered,
        "features_multi_step": lambda: run(multi_step_features(history, CFG)),
        "arima_forecast": lambda: run(forecast_arima(history, CFG)),
        "ridge_grid": lambda: run(search_ridge(history, CFG)),
        "var_forecast": lambda: run(forecast_var(history, CFG)),
        "window_forecast": lambda: run(forecast_window(history, CFG)),
    }
    # Timed, but not part of the total, which stays comparable from round to round.
    more = {
        "shared_leaderboard": lambda: run(REGISTRY["shared_leaderboard"](spark, sf_dir)),
        "forest_forecast": lambda: run(forecast_forest(history, CFG)),
        "forest_grid": lambda: run(search_forest(history, CFG)),
    }
    REGISTRY["scan_demand"](spark, sf_dir)  # writes the table that is scanned

    def timed(jobs: dict) -> dict[str, float]:
        seconds = {}
        for name, job in jobs.items():
            start = time.perf_counter()
            job()
            seconds[name] = round(time.perf_counter() - start, 3)
        return seconds

    seconds = timed(work)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "more": timed(more) if os.environ.get("BENCH_MORE", "1") == "1" else {},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
