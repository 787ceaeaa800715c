"""The corpus queries that have SQL against DuckDB, over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from jobloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        duck.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str)
