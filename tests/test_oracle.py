"""Every query with SQL equals DuckDB's result on sf0.001 (the driver's gate runs sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.helpers import digest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_duckdb(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(entry.oracle_sql()[name])
    want = digest(rel.columns, rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert entry.queries()[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["a", "b", "confidence", "lift"]
    assert df.count() > 0
