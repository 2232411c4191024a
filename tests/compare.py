"""Compare a registered query with its SQL: column names, row count, sorted values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(r[i] for i in order) for r in rows]
    return sorted(plain, key=repr)


SPARK_TYPES = {"DOUBLE": "double", "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean"}


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs."""
    want_rel = con.sql(sql)
    got_types = dict(spark_df.dtypes)
    want_types = {c: SPARK_TYPES.get(str(t), str(t)) for c, t in zip(want_rel.columns, want_rel.types)}
    if got_types != want_types:
        return f"columns differ: {sorted(set(got_types.items()) ^ set(want_types.items()))}"
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    want = _rows(want_rel.columns, want_rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not _same(g, w)]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def _same(a: tuple, b: tuple) -> bool:
    return all(
        x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
        for x, y in zip(a, b)
    )
