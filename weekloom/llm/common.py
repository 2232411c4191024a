"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.session import stage

#: White space of the contracts, as the inside of a regular-expression class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Maximal runs without white space; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def strip(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


#: A side of a join is broadcast up to this size, which is measured first.
BROADCAST_BYTES = 64_000_000


def identity(*columns: str) -> dict[str, Column]:
    """``_k1``, ``_k2``: 128 bits that rows share only if they agree in ``columns``."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return {f"_k{seed}": F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)}


KEY = ["_k1", "_k2"]


def join_measured(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: Column | int) -> DataFrame:
    """Join with a staged side, broadcast if its measured size allows, else by a shuffle that splits skew."""
    size = right.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return left.join(F.broadcast(right) if size <= BROADCAST_BYTES else right, on, how)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Stage ``df`` with a number per row, ``_row``, that stays the same for every later reader.

    It tells repeated rows and rows without an id apart.
    """
    return stage(df.withColumn("_row", F.monotonically_increasing_id()), name)


def with_text(df: DataFrame, new: str) -> DataFrame:
    """The input rows in ``_doc`` with ``text`` from column ``new``; ``n_chars``, where there is one, follows."""
    columns = df.schema["_doc"].dataType.names
    made = {"text": F.col(new), "n_chars": F.length(new).cast("long")}
    return df.select(*(made.get(c, F.col("_doc").getField(c)).alias(c) for c in columns))
