"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.session import stage


def _measure(edges: DataFrame) -> tuple:
    """Count and order-free sum of an edge table."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(``v``, ``component``) for every vertex of ``edges`` (``a``, ``b``): the smallest vertex it can reach.

    Each round is two aggregations with joins on edges only, staged, so nothing whole passes the driver and a
    lost executor costs one round. A vertex with very many edges is pre-aggregated and its join is split.
    """
    edges = stage(edges.select("a", "b").where("a != b").distinct(), "edges")
    before = _measure(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (
            both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        )
        large = stage(large.distinct(), "edges")
        # Now a > b in every row.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(near.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _measure(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("v")).distinct()
    return edges.select(F.col("a").alias("v"), F.col("b").alias("component")).union(
        roots.select("v", F.col("v").alias("component"))
    )
