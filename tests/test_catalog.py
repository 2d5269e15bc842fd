"""Every core query with SQL gives what the SQL gives on the smallest tables."""

import os

import duckdb
import pytest

from strandweave.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, tables, name):
    want = tables.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, DATA)
    order = want.columns
    assert sorted(got.columns) == sorted(order)
    rows = got.select(*[f"`{c}`" for c in order]).collect()
    assert sorted(repr(tuple(map(plain, r))) for r in rows) == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())
