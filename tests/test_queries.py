"""Every engine query with SQL against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from lodeline.plans import corpora, queries

QUERIES, ORACLE_SQL = queries.QUERIES | corpora.QUERIES, queries.ORACLE_SQL | corpora.ORACLE_SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return tuple(v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(ORACLE_SQL[name])
    at = [d[0] for d in res.description]
    assert sorted(at) == cols
    want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want
