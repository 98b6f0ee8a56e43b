"""Every registered query with SQL gives the same rows as DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sceneloom.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return f"{v:.5f}"
    return str(list(v)) if hasattr(v, "tolist") and not hasattr(v, "item") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rel = duck.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    want = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(cell(r[c]) for c in names) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
