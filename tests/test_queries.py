"""Each registered planning query against its SQL on DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from jobloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf, t)}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat()
    return v


def bag(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rel = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})")
    assert bag(map(tuple, df.select(*columns).collect())) == bag(rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
