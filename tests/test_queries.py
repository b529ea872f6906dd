"""Every query with SQL gives the same rows as DuckDB at the smallest scale."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from provlake.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return "None" if x != x else f"{float(x):.9g}"
    if isinstance(x, (list, np.ndarray)):
        return str([cell(y) for y in x])
    return "None" if x is None or x is pd.NA else str(x)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_module(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).count() > 0
