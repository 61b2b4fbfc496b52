"""Every query with SQL against DuckDB on the same small tables."""

import datetime
import glob
import os

import duckdb
import pytest

from seamline.plans import registry_more  # noqa: F401
from seamline.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows_of(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = rows_of(df.select(*columns).collect())
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == rows_of([tuple(r[i] for i in at) for r in want.fetchall()])
