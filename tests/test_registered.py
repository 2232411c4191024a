"""Every registered query with SQL, compared value by value on the supplied tables."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 24 * 158
