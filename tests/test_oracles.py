"""Named queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from folio.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, (bool, str)):
        return x
    return round(float(x), 6) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "__float__") else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    result = db.sql(catalogue.ORACLES[name])
    assert sorted(result.columns) == columns
    rows = lambda found: sorted((tuple(map(value, r)) for r in found), key=str)
    assert rows(got.select(*columns).collect()) == rows(result.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
