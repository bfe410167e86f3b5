"""Every query of the catalogue against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tidelog.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted(tuple(str(r[c]) for c in columns) for r in found.collect())
    rows = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in rows.fetchall())
    assert mine == theirs


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())
