"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from strataweave import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    tidy = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return cols, sorted(str(tuple(tidy(v) for v in r)) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_duckdb(spark, sf, duck, name):
    assert rows(core.queries()[name](spark, sf).toPandas()) == rows(duck.sql(core.oracle_sql()[name]).df())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["source", "rows_in_group", "with_heading"] and out.count() > 0
