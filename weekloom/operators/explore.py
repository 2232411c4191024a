"""Exploration tables: moments, attribute hierarchy, correlation, density, seasonality."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.config import ATTRIBUTES, COUNTER, DAY, KEY, MEASURES, QTY
from weekloom.operators.series import product_weeks


def describe_measures(df: DataFrame) -> DataFrame:
    """Mean, maximum and minimum of each numeric measure."""
    cols = [*MEASURES, COUNTER]
    one = df.agg(
        *[
            F.struct(
                F.avg(c).alias("mean"),
                F.max(c).cast("double").alias("max"),
                F.min(c).cast("double").alias("min"),
            ).alias(c)
            for c in cols
        ]
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"{c}.*")) for c in cols])))


def attribute_hierarchy(df: DataFrame, cols: tuple[str, ...] = (KEY, *ATTRIBUTES)) -> DataFrame:
    """For each ordered pair of attributes: does a value of the first fix the second?

    The data is first reduced to its distinct attribute tuples (partial aggregation). Pairs
    without the product come from the far fewer tuples that remain when it is left out.
    """
    tuples = df.select(*cols).distinct()
    others = [c for c in cols if c != KEY]
    pairs = _value_pairs(tuples.select(*others).distinct(), list(permutations(others, 2)))
    if KEY in cols:
        with_key = [p for p in permutations(cols, 2) if KEY in p]
        pairs = pairs.unionByName(_value_pairs(tuples, with_key))
    per_value = pairs.groupBy("attribute", "dependent", "a").agg(F.count("b").alias("dependents"))
    return per_value.groupBy("attribute", "dependent").agg(
        F.count("*").alias("n_values"),
        F.max("dependents").alias("max_dependents"),
        (F.max("dependents") <= 1).alias("determines"),
    )


def _value_pairs(tuples: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Distinct value pairs (a, b) of each attribute pair."""
    cells = [
        F.struct(
            F.lit(x).alias("attribute"),
            F.lit(y).alias("dependent"),
            F.col(x).cast("string").alias("a"),
            F.col(y).cast("string").alias("b"),
        )
        for x, y in pairs
    ]
    return tuples.select(F.inline(F.array(*cells))).distinct()


def measure_correlation(df: DataFrame) -> DataFrame:
    """Pearson correlation of each pair of measures, in one pass."""
    pairs = list(combinations([*MEASURES, COUNTER], 2))
    one = df.agg(*[F.corr(a, F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("measure_a"), F.lit(b).alias("measure_b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return one.select(F.inline(F.array(*rows)))


def density_grid(df: DataFrame, col: str = QTY, points: int = 100) -> DataFrame:
    """Gaussian kernel density on an even grid from min - range/2 to max + range/2.

    Bandwidth: sample sigma times n^(-1/5). Rows are first counted per distinct value; then each
    grid point is one weighted sum, so nothing is multiplied by the grid.
    """
    span = F.max(col) - F.min(col)
    stats = df.agg(
        F.struct(
            F.count(col).alias("n"),
            (F.stddev_samp(col) * F.pow(F.count(col).cast("double"), F.lit(-0.2))).alias("h"),
            (F.min(col) - span / 2).alias("lo"),
            (span * 2 / (points - 1)).alias("gap"),
        )
    ).scalar()
    # The statistics ride along as columns: plain attributes keep the sums below compact.
    values = (
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("v"))
        .agg(F.count("*").alias("k"))
        .withColumn("s", stats)
        .select("v", "k", "s.*")
    )
    scaled = values.withColumns({"u": (F.col("v") - F.col("lo")) / F.col("h"), "du": F.col("gap") / F.col("h")})
    sums = [
        F.sum(F.col("k") * F.exp((F.col("u") - i * F.col("du")) * (F.col("u") - i * F.col("du")) / -2)).alias(f"s{i}")
        for i in range(points)
    ]
    keep = [F.max(c).alias(c) for c in ("n", "h", "lo", "gap")]
    one = scaled.agg(*sums, *keep)
    rows = F.array(*[F.struct(F.lit(i).alias("point"), F.col(f"s{i}").alias("s")) for i in range(points)])
    norm = F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi())
    return one.select("n", "h", "lo", "gap", F.inline(rows)).select(
        "point",
        (F.col("lo") + F.col("point") * F.col("gap")).alias("value"),
        (F.col("s") / norm).alias("density"),
    )


def binned_density(df: DataFrame, col: str = QTY, points: int = 100, cells: int = 4096) -> DataFrame:
    """The same density for a measure of any number of distinct values, within ``error_bound``.

    Each value is shared out between the two nearest of ``cells`` + 1 even marks from the smallest to the largest
    (linear binning), so a task sends at most so many sums, and the kernel is summed over marks. Shared out so, a
    kernel is replaced by its chord over a cell of width d, which is off by d * d / 8 times its largest
    curvature, 1 / (h ** 3 * sqrt(2 pi)), at most.
    """
    span = F.max(col) - F.min(col)
    stats = df.agg(
        F.struct(
            F.count(col).alias("n"),
            (F.stddev_samp(col) * F.pow(F.count(col).cast("double"), F.lit(-0.2))).alias("h"),
            F.min(col).cast("double").alias("least"),
            (span / cells).alias("d"),
            (F.min(col) - span / 2).alias("lo"),
            (span * 2 / (points - 1)).alias("gap"),
        )
    ).scalar()
    placed = df.where(F.col(col).isNotNull()).select(
        (F.try_divide(F.col(col) - stats["least"], stats["d"])).alias("at")
    )
    low = F.least(F.floor("at"), F.lit(cells - 1))
    share = F.col("at") - low
    both = F.array(
        F.struct(low.alias("mark"), (1 - share).alias("w")), F.struct((low + 1).alias("mark"), share.alias("w"))
    )
    marks = placed.select(F.inline(both)).groupBy("mark").agg(F.sum("w").alias("w")).withColumn("s", stats)
    x = F.col("s.least") + F.col("mark") * F.col("s.d")
    value = F.col("s.lo") + F.col("point") * F.col("s.gap")
    kernel = F.exp(-F.pow((x - value) / F.col("s.h"), F.lit(2.0)) / 2)
    root = F.sqrt(F.lit(2.0) * F.pi())
    # At most cells x points rows, whatever the size of the data.
    return (
        marks.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy("point", "s")
        .agg(F.sum(F.col("w") * kernel).alias("sum"))
        .select(
            "point",
            value.alias("value"),
            (F.col("sum") / (F.col("s.n") * F.col("s.h") * root)).alias("density"),
            (F.pow("s.d", F.lit(2.0)) / 8 / (F.pow("s.h", F.lit(3.0)) * root)).alias("error_bound"),
        )
    )


def seasonal_index(df: DataFrame, col: str = QTY) -> DataFrame:
    """Mean per ISO week of the year, divided by the overall mean."""
    overall = df.agg(F.avg(col)).scalar()
    return (
        df.groupBy(F.weekofyear(DAY).alias("iso_week"))
        .agg(F.avg(col).alias("mean"), F.count("*").alias("n"))
        .withColumn("seasonal_index", F.try_divide(F.col("mean"), overall))
    )


def autocorrelation(df: DataFrame, lag: int = 52, col: str = QTY) -> DataFrame:
    """Per product: correlation of the value with the one ``lag`` weeks earlier; null if constant."""
    pairs = df.select(KEY, F.col(col).alias("x"), F.lag(col, lag).over(product_weeks()).alias("z"))
    known = pairs.where(F.col("z").isNotNull())
    varies = (F.max("x") > F.min("x")) & (F.max("z") > F.min("z"))
    return known.groupBy(KEY).agg(
        F.count("*").alias("pairs"), F.when(varies, F.corr("x", "z")).alias("autocorrelation")
    )
