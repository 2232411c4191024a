"""Cross-product sums (Gram matrices) of design rows, the distributed half of every least-squares
fit here.

Each task adds up Z'Z of its own rows, so what is shuffled depends on the number of keys and
columns, not on the number of rows. With a key the series are first rebalanced on it: a task meets few
keys, and a key with a large share of the rows is spread over several tasks. No pairs of rows or of
products are ever produced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Design = Callable[[np.ndarray], np.ndarray]

# Series turned into design rows at a time, and partial matrices a task holds before it emits them.
SERIES_PER_STEP = 256
KEYS_IN_MEMORY = 512


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a 2-D array; all lists must have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width:
        raise ValueError(f"series must all have {width} values; complete the weekly grid first")
    return flat.reshape(-1, width)


def series_length(df: DataFrame, column: str, need: int) -> int:
    """Length of the array column; fewer than ``need`` values are refused."""
    length = df.agg(F.max(F.size(column))).first()[0] or 0
    if length < need:
        raise ValueError(f"{length} weeks are too few, {need} are needed")
    return length


def gram(df: DataFrame, column: str, width: int, designs: dict[int, Design], key: str | None = None) -> DataFrame:
    """(key, design, i, j, s): s = sum over design rows of z_i z_j, for i <= j.

    ``column`` is an array column of ``width`` values. Each design maps a block of series to
    design rows; all designs share one pass over the data.
    """
    names = list(designs)
    fields = f"{key} bigint, " if key else ""
    schema = fields + "design int, i int, part array<double>"
    arrow = [pa.field(key, pa.int64())] if key else []
    arrow += [pa.field("design", pa.int32()), pa.field("i", pa.int32()), pa.field("part", pa.list_(pa.float64()))]
    out_schema = pa.schema(arrow)

    def emit(parts: dict) -> pa.RecordBatch:
        rows = [
            ({key: k} if key else {}) | {"design": d, "i": i, "part": m[i, i:]}
            for (k, d), m in parts.items()
            for i in range(len(m))
        ]
        return pa.RecordBatch.from_pylist(rows, schema=out_schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {}
        for batch in batches:
            y = matrix_of(batch.column(column), width)
            keys = batch.column(key).to_numpy(zero_copy_only=False) if key else np.zeros(len(y))
            order = np.argsort(keys, kind="stable")
            found, starts = np.unique(keys[order], return_index=True)
            for k, rows in zip(found, np.split(order, starts[1:])):
                block = y[rows]
                for lo in range(0, len(block), SERIES_PER_STEP):
                    for name in names:
                        z = designs[name](block[lo : lo + SERIES_PER_STEP])
                        where = (int(k), name)
                        parts[where] = parts[where] + z.T @ z if where in parts else z.T @ z
                if len(parts) >= KEYS_IN_MEMORY:
                    yield emit(parts)
                    parts = {}
        if parts:
            yield emit(parts)

    group = [key] if key else []
    series = df.select(*group, column)
    if key:
        # Few keys per task, so partial matrices stay fewer than series; a hot key is split over tasks.
        series = series.hint("rebalance", key)
    pieces = series.mapInArrow(partial, schema)
    # Rows are already combined per task; one shuffle by matrix row, then the sums need no other.
    return (
        pieces.repartition(*group, "design", "i")
        .select(*group, "design", "i", F.posexplode("part").alias("offset", "s"))
        .groupBy(*group, "design", "i", "offset")
        .agg(F.sum("s").alias("s"))
        .select(*group, "design", "i", (F.col("i") + F.col("offset")).alias("j"), "s")
    )


def matrix(rows: pd.DataFrame) -> np.ndarray:
    """Symmetric matrix from its (i, j, s) rows."""
    size = int(rows["j"].max()) + 1
    m = np.zeros((size, size))
    m[rows["i"], rows["j"]] = rows["s"]
    m[rows["j"], rows["i"]] = rows["s"]
    return m
