"""Every registered query against its SQL, or at least for rows, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from workload.check import compare, duck

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "snippet" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
