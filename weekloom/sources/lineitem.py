"""Raw weekly demand derived from order lines and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Part types in the order of their numbers 1..6.
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _sales_week(day: Column) -> Column:
    """Week number within the calendar year, week 1 being the one that holds January 1."""
    monday = F.date_sub(day, F.weekday(day))
    jan1 = F.trunc(day, "year")
    first_monday = F.date_sub(jan1, F.weekday(jan1))
    return (F.lit(1) + F.floor(F.datediff(monday, first_monday) / 7)).cast("int")


def raw_demand(spark: SparkSession, sf_dir: str, key: str = "brand_type") -> DataFrame:
    """One row per (product, sales_year, sales_week).

    ``key`` picks what counts as a product: ``brand_type``, ``brand`` or ``supplier``. Part types outside
    ``PART_TYPES`` are kind 0, a group of their own.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        F.col("l_shipdate").cast("date").alias("day"),
    )
    if key == "supplier":
        brand = (F.col("l_suppkey") % 25 + 1).cast("bigint")
        kind = (F.col("l_suppkey") % 6 + 1).cast("bigint")
        label = F.concat(F.lit("Brand#"), brand.cast("string"))
        product = F.col("l_suppkey")
    else:
        # Brand and kind are worked out once per part, not once per order line.
        parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
            "p_partkey",
            F.col("p_brand").alias("label"),
            F.regexp_extract("p_brand", r"^Brand#(\d+)$", 1).cast("bigint").alias("brand"),
            F.array_position(F.array(*[F.lit(t) for t in PART_TYPES]), F.col("p_type")).alias("kind"),
        )
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        brand, kind, label = F.col("brand"), F.col("kind"), F.col("label")
        product = brand * 10 + kind if key == "brand_type" else brand
        if key == "brand":
            kind = brand % 6 + 1

    return (
        lines.select(
            product.alias("product_id"),
            F.year("day").alias("sales_year"),
            _sales_week(F.col("day")).alias("sales_week"),
            brand.alias("brand"),
            kind.alias("kind"),
            label.alias("label"),
            "l_quantity",
            "l_extendedprice",
            "l_discount",
        )
        .groupBy("product_id", "sales_year", "sales_week", "brand", "kind", "label")
        .agg(
            F.sum("l_quantity").alias("total_qty"),
            F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("avg_sales_price"),
            # adding zero turns -0.0 into 0.0
            F.sum(F.col("l_extendedprice") * (F.col("l_discount") + F.lit(0.0))).alias("total_discount_value"),
            F.count("*").alias("sales_date_weekly_number"),
        )
        .select(
            "product_id",
            "sales_year",
            "sales_week",
            "total_qty",
            "avg_sales_price",
            "total_discount_value",
            "sales_date_weekly_number",
            F.when(F.col("brand") % 2 == 0, "Y").otherwise("N").alias("is_stock"),
            F.concat(F.lit("EC"), F.lpad(F.col("brand").cast("string"), 6, "0")).alias("etim_class_id"),
            F.col("label").alias("etim_class"),
            F.col("brand").alias("sis_sub_family_id"),
            F.col("label").alias("sis_sub_family"),
            F.col("kind").alias("sis_group_id"),
            (F.col("brand") % 7).alias("vendor_id"),
        )
    )
