"""Scans and sinks: managed tables named after the country, and Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weekloom.config import ForecastConfig

DEMAND_SCHEMA = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("sales_year", T.IntegerType()),
        T.StructField("sales_week", T.IntegerType()),
        T.StructField("total_qty", T.DoubleType()),
        T.StructField("avg_sales_price", T.DoubleType()),
        T.StructField("total_discount_value", T.DoubleType()),
        T.StructField("sales_date_weekly_number", T.LongType()),
        T.StructField("is_stock", T.StringType()),
        T.StructField("etim_class_id", T.StringType()),
        T.StructField("etim_class", T.StringType()),
        T.StructField("sis_sub_family_id", T.LongType()),
        T.StructField("sis_sub_family", T.StringType()),
        T.StructField("sis_group_id", T.LongType()),
        T.StructField("vendor_id", T.LongType()),
    ]
)


def scan_demand(spark: SparkSession, cfg: ForecastConfig, path: str | None = None) -> DataFrame:
    """The raw weekly table of the country, or the same columns from a Parquet folder."""
    df = spark.read.schema(DEMAND_SCHEMA).parquet(path) if path else spark.table(cfg.table())
    return df.select(DEMAND_SCHEMA.fieldNames())


def scan_filtered(spark: SparkSession, cfg: ForecastConfig) -> DataFrame:
    """The prepared table every forecaster reads."""
    return spark.table(cfg.table("Filtered"))


def write_table(df: DataFrame, name: str, partition_by: str | None = None) -> None:
    """Overwrite a managed table.

    With ``partition_by`` the rows are rebalanced on that column first: adaptive execution
    writes few files per value and still splits a value that holds a large share of the rows.
    """
    if partition_by:
        df.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).saveAsTable(name)
    else:
        df.write.mode("overwrite").saveAsTable(name)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """The same as ``write_table`` into a Parquet folder."""
    if partition_by:
        df.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_series_table(df: DataFrame, name: str, buckets: int) -> None:
    """Overwrite a table bucketed and sorted by product, so that later per-product windows
    read it without a shuffle."""
    (
        df.repartition(buckets, "product_id")
        .write.mode("overwrite")
        .bucketBy(buckets, "product_id")
        .sortBy("product_id", "First_day")
        .saveAsTable(name)
    )
