"""One frozen parameter object, passed to every operator that needs one."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Column roles of the weekly demand table.
KEY = "product_id"
DAY = "First_day"
QTY = "total_qty"
PRICE = "avg_sales_price"
DISCOUNT = "total_discount_value"
COUNTER = "sales_date_weekly_number"
MEASURES = (QTY, PRICE, DISCOUNT)
GROUP = "sis_group_id"
FLAG = "Forte_rotation"
ATTRIBUTES = (
    "is_stock",
    "etim_class_id",
    "etim_class",
    "sis_sub_family_id",
    "sis_sub_family",
    "sis_group_id",
    "vendor_id",
)


@dataclass(frozen=True)
class ForecastConfig:
    # Defaults that decide the results.
    country: str = "DEU"
    min_rotation: int = 40  # products need more rows than this
    keep_weeks: int = 158  # newest weeks kept
    high_rotation_weeks: int = 100  # high rotation: more weeks than this
    gap_neighbour_weeks: int = 100  # calendar repair by neighbours: at least this many weeks
    edge_gap: str = "drop"  # isolated outermost week: "drop" it or "fill" the gap
    sigma: float = 3.0
    cov_cut: float = 1.0
    adf_level: float = 0.05
    train_share: float = 0.85
    split_date: dt.date = dt.date(2022, 1, 3)
    steps: tuple[int, ...] = (1, 2, 3, 4, 12, 26)
    arima_steps: tuple[int, ...] = (1, 2, 3, 4, 12, 24)
    arima_horizon: int = 24
    arima_test: int | None = None  # newest weeks held out; None: all but the train share
    arima_max_p: int = 5  # orders searched: all (p, q) up to these
    arima_max_q: int = 5
    arima_long: int = 10  # lags of the autoregression that yields the first innovations
    forest_depth: int = 10  # MLlib takes up to 30
    forest_bins: int = 32  # split candidates per feature
    ridge_train: int = 100
    ridge_valid: int = 32
    ridge_test: int = 26
    var_lags: int = 10
    var_test: int = 30
    window: int = 50
    series_buckets: int = 32  # files of the table that forecasters read by product
    scale_fit_on: str = "all"  # "all" rows, or "train" rows only

    def table(self, suffix: str = "") -> str:
        """Name of the raw (``""``), ``FINAL`` or ``Filtered`` table of the country."""
        return f"DATA_{self.country}" + (f"_{suffix}" if suffix else "")

    def score_table(self, metric: str, model: str) -> str:
        return f"{metric}_{model}_{self.country}"
