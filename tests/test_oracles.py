"""Every query that has SQL gives the rows that DuckDB gives."""

import datetime
import math
import os

import duckdb
import pytest

from memoria import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, db, name):
    df = plans.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    con = db.execute(plans.SQL[name])
    names = [d[0] for d in con.description]
    theirs = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in con.fetchall())
    assert sorted(names) == cols
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_rows_only(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0
