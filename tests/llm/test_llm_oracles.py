"""Text queries beside their SQL, and held-out accuracy, on the smallest tables."""

import duckdb
import pytest

import compare
from moorgrid.llm import queries as Q


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    compare.views(c, data)
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows(spark, con, data, name):
    got, want = Q.QUERIES[name](spark, data).toPandas(), con.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.canon(got) == compare.canon(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() >= 0
