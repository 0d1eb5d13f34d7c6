"""Every registered query with a SQL twin agrees with DuckDB on the sf0.001 tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.oracle_check import connect, rows_of

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    s_rows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    rel = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    d_rows = rows_of(cols, rel.fetchall())
    assert sorted(sdf.columns) == sorted(cols)
    assert s_rows == d_rows


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SF)
