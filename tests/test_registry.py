"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def _plain(rows):
    return sorted(tuple("" if v is None or v != v else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, oracle, name):
    ours = entry.queries()[name](spark, DIR)
    theirs = oracle.sql(entry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    order = sorted(ours.columns)
    rows = theirs.fetchall()
    at = [theirs.columns.index(c) for c in order]
    assert _plain([tuple(r[c] for c in order) for r in ours.collect()]) == _plain([tuple(r[i] for i in at) for r in rows])


def test_entry(spark):
    if os.path.isdir(DIR):
        assert entry.entry(spark).count() > 0
