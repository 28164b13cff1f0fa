"""Every registered query against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
# the corpus queries have their own tests beside them
KEYS = [k for k in SQL if not k.startswith("op") and k != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(os.path.join(FOLDER, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rel = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    order = [rel.columns.index(c) for c in cols]
    assert compare(got, [tuple(r[i] for i in order) for r in rel.fetchall()]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_keys_are_query_keys():
    assert set(SQL) <= set(entry.queries())
