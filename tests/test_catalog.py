"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from gristmill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    found = tables.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, rows)) == Counter(tuple(r[i] for i in at) for r in found.fetchall())
