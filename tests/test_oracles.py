"""Queries of the core beside their SQL on the smallest tables."""

import duckdb
import pytest

import compare
from moorgrid.plans import pages, problems, ranking, store

PARTS = [store, ranking, pages, problems]
NAMES = [k for p in PARTS for k in p.ORACLES]


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    compare.views(c, data)
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, data, name):
    f = next(p.QUERIES[name] for p in PARTS if name in p.QUERIES)
    sql = next(p.ORACLES[name] for p in PARTS if name in p.ORACLES)
    got, want = f(spark, data).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.canon(got) == compare.canon(want)
