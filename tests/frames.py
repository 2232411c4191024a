"""Tiny hand-made demand frames."""

import datetime as dt

from weekloom.sources.tables import DEMAND_SCHEMA

MONDAY = dt.date(2020, 1, 6)
ATTRS = {
    "is_stock": "Y",
    "etim_class_id": "EC000123",
    "etim_class": "cable",
    "sis_sub_family_id": 7,
    "sis_sub_family": "wire",
    "sis_group_id": 1,
    "vendor_id": 3,
}


def monday(i):
    return MONDAY + dt.timedelta(days=7 * i)


def demand(spark, cells, **attrs):
    """Rows with First_day from (product, week index, quantity[, weekly number]) tuples."""
    rows = []
    for product, week, qty, *rest in cells:
        day = monday(week)
        rows.append(
            {
                "product_id": product,
                "sales_year": day.year,
                "sales_week": day.isocalendar()[1],
                "total_qty": float(qty),
                "avg_sales_price": float(qty) * 10,
                "total_discount_value": float(qty) / 2,
                "sales_date_weekly_number": rest[0] if rest else 1,
                **ATTRS,
                **attrs,
                "First_day": day,
            }
        )
    return spark.createDataFrame(rows, DEMAND_SCHEMA.simpleString()[7:-1] + ",First_day:date")


def values(df, col="total_qty"):
    """{(product, week index): value}"""
    return {(r["product_id"], (r["First_day"] - MONDAY).days // 7): r[col] for r in df.collect()}
