"""Every query with SQL of its own against DuckDB, over the smallest tables."""

import datetime
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_module

QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating)):
        return None if x != x else round(float(x), 6) + 0.0
    if isinstance(x, (int, np.integer)):
        return float(int(x))
    if isinstance(x, (pd.Timestamp, datetime.datetime)):
        t = pd.Timestamp(x)
        return str(t.tz_convert(None) if t.tzinfo else t)
    return x


def canonical(df):
    return Counter(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{data}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_as_in_sql(spark, data, duck, name):
    have, want = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert canonical(have) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    """Queries that SQL can't say run to their end, give their columns, and rows that aren't all null."""
    df = QUERIES[name](spark, data.replace("sf0.001", "sf0.01"))  # of the smallest tables some give nothing
    found = df.collect()
    assert df.columns and found and any(any(v is not None for v in r) for r in found)


def test_entry(spark, data):
    assert entry_module.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(ORACLE) <= set(QUERIES)
