"""Every query with SQL is held against it on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from tidemark.plans import catalog
from tidemark.sources.adapters import DRIVER_TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 3)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 3)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def near(a, b):
    return a == b or isinstance(a, float | int) and isinstance(b, float | int) and abs(a - b) <= 0.002 * max(1.0, abs(a))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    cursor = con.execute(catalog.ORACLE_SQL[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda row: [str(x) for x in row if not isinstance(x, float)] + [x for x in row if isinstance(x, float)]
    a = sorted((tuple(norm(r[c]) for c in order) for r in got.collect()), key=lambda r: repr(key(r)))
    b = sorted((tuple(norm(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=lambda r: repr(key(r)))
    assert len(a) == len(b)
    assert all(near(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True)), next((r, s) for r, s in zip(a, b, strict=True) if not all(map(near, r, s)))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    assert catalog.QUERIES[name](spark, SF).count() > 0
