"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from conftest import DATA
from docfields.catalog import ORACLES, QUERIES
from docfields.plans.fixtures import TABLES


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v else "0"
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if v == int(v) else repr(round(float(v), 6))
    if isinstance(v, datetime.datetime):
        return v.isoformat()[:19]
    return str(v)


def order(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    assert rows
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=order)
