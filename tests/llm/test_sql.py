"""Corpus queries that SQL can express give the rows that DuckDB gives; all are registered."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from strataweave.llm import queries as llm


def rows(df):
    cols = sorted(df.columns)
    tidy = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return cols, sorted(str(tuple(tidy(v) for v in r)) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(llm.queries()[name](spark, sf).toPandas()) == rows(con.sql(llm.oracle_sql()[name]).df())


def test_all_are_registered(spark, sf):
    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert llm.queries()["op9_decision_list"](spark, sf).columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
