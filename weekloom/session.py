"""Session defaults, staging of shared intermediate results, checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g", conf: dict[str, str] | None = None
) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weekloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in (conf or {}).items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a private one only for local masters."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weekloom-"))
        folder = sc.getCheckpointDir()
    return folder


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that several later jobs read: the lineage is cut, the files outlive any
    executor, and each reader prunes columns and pushes filters into Parquet. With ``partition_by``
    readers of one value skip the files of the others; the rows are rebalanced on it first, which
    splits a value that holds a large share.
    """
    path = f"{staging_dir(df.sparkSession)}/weekloom/{name}-{uuid.uuid4().hex}"
    if partition_by:
        df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_all(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Write frames of one schema one after the other into one staged table.

    The plan stays small however many parts there are, and what made a part can be let go.
    """
    path = schema = None
    for df in parts:
        if path is None:
            path, schema = f"{staging_dir(df.sparkSession)}/weekloom/{name}-{uuid.uuid4().hex}", df.schema
        df.write.mode("append").parquet(path)
    if path is None:
        raise ValueError(f"nothing to stage for {name}")
    return df.sparkSession.read.schema(schema).parquet(path)


def join_small(
    left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", max_rows: int = 100_000
) -> DataFrame:
    """Join a staged side that is expected to be small.

    The side is broadcast only when its counted size is within ``max_rows``; a larger one goes
    through a plain shuffle join, where adaptive execution splits skewed partitions.
    """
    if right.limit(max_rows + 1).count() <= max_rows:
        right = F.broadcast(right)
    return left.join(right, on, how)
