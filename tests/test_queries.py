"""Every core query runs; those with SQL agree with it on the smallest tables."""

import math
import os
from collections import Counter

import pytest

from loam.oracle import SQL
from loam.queries import FLAGSHIP, QUERIES

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() else v
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def twin():
    from tests.conftest import DATA

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, twin, name):
    df = QUERIES[name](spark, data)
    found = twin.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    assert Counter(tuple(plain(v) for v in r) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_flagship():
    assert FLAGSHIP in QUERIES and FLAGSHIP in SQL
