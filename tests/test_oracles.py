"""Every query against its SQL in another engine, at the smallest scale."""

import os

import duckdb
import pytest

from lumenrec.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def other(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda x: f"{x:.6f}" if isinstance(x, float) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, other, name):
    ours, theirs = normal(QUERIES[name](spark, sf).toPandas()), normal(other.execute(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)
