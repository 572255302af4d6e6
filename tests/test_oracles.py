"""Every registered query of the procurement operators against its SQL, over the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry._registered()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
