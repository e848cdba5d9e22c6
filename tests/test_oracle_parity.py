"""Every registered query with a SQL twin gives the same rows as DuckDB on
the smallest scale factor (columns sorted by name, rows as a multiset)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from stockpulse.sources.tables import TABLES
from conftest import SF_SMALL

SQL = E.oracle_sql()


def _norm(df):
    cols = sorted(df.columns)
    rows = []
    for r in df[cols].itertuples(index=False):
        out = []
        for v in r:
            if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                out.append(None)
            elif hasattr(v, "isoformat"):
                out.append(pd.Timestamp(v).isoformat())
            elif hasattr(v, "item"):
                out.append(v.item())
            else:
                out.append(v)
        rows.append(tuple(out))
    rows.sort(key=lambda t: tuple((x is None, str(x)) for x in t))
    return cols, rows


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_sql_key_is_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(SQL[name]).df()
    c1, r1 = _norm(got)
    c2, r2 = _norm(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
