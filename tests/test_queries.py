"""Every registered query against its SQL text on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        exact, _, message = compare(df, con, ORACLES[name])
        assert exact, message
    else:
        assert df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() == 4
