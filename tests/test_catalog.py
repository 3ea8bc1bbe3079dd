"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import math
import os

import duckdb
import pytest

import cases

from tessera.plans import catalog, derived, repositories  # noqa: F401

QUERIES, ORACLES = catalog.QUERIES | cases.QUERIES, catalog.ORACLES | cases.ORACLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = sorted(tuple(str(plain(v)) for v in r) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert rows == sorted(tuple(str(plain(r[k])) for k in order) for r in got.fetchall())
