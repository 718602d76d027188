"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from cellwright.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert compare(spark, SF, name, QUERIES[name], SQL[name], con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, con, name):
    assert QUERIES[name](spark, SF).count() > 0
