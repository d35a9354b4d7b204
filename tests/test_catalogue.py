"""Every query with SQL is held against DuckDB, value by value."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from citelake.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, float) else round(x, 6)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rel = con.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert (x == y) or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9)), (a, b)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 21
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
