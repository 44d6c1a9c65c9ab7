"""Queries that SQL can express against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from prismatic.llm import queries

DIR = "/root/testdata/sf0.001"


def plain(p):
    return sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in p[sorted(p.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got, want = queries.queries()[name](spark, DIR).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
