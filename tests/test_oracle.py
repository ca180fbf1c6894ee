"""Every registered query that has a SQL twin gives the same rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

BASE = os.environ.get("FOLIOTAB_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{BASE}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v).replace("+00:00", "") if hasattr(v, "isoformat") else repr(v)


def rows(table):
    cols = sorted(table.column_names)
    return cols, sorted(tuple(norm(v) for v in r) for r in zip(*[table.column(c).to_pylist() for c in cols]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = rows(QUERIES[name](spark, BASE).toArrow())
    if name in SQL:
        assert got == rows(con.execute(SQL[name]).to_arrow_table())
    else:
        assert got[1]


def test_entry(spark):
    assert E.entry(spark).count() > 0
