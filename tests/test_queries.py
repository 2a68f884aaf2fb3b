"""Every core query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from lexassay.plans import catalogue

from .conftest import SMALL


def _norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SMALL):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{SMALL}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, con, name):
    df = catalogue.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(map(_norm, r)) for r in df.select(*cols).collect())
    r = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(_norm(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()
