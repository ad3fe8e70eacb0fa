"""Every query that has SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from skein import queries, vendor_queries

QUERIES, ORACLE = queries.QUERIES | vendor_queries.QUERIES, queries.ORACLE | vendor_queries.ORACLE
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.sql(f"create view {name} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return db


def normal(value):
    if value is None or pd.isna(value):
        return None
    if isinstance(value, (pd.Timestamp,)) or hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if hasattr(value, "item"):
        value = value.item()
    return int(value) if isinstance(value, float) and value == int(value) else value


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(normal, r)) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and len(got) > 0
    assert rows(got) == rows(want)
