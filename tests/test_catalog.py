"""Every registered query against its SQL over the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


def rows(df):
    columns = sorted(df.columns)
    found = [tuple(plain(v) for v in row) for row in df[columns].itertuples(index=False, name=None)]
    return columns, sorted(found, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        assert rows(got) == rows(db.execute(sql).df())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
