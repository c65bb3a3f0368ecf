"""The driver's contract on the smallest tables: every query runs, and equals its SQL."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else x
    return str(x) if type(x).__name__ in ("datetime", "date", "Decimal") else x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() == 3


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


CORE = [n for n in entry.queries() if not n.startswith(("p2_", "p3_", "p5_", "p6_", "p7_", "p8_"))]


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in entry.oracle_sql():
        found = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted((tuple(value(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=repr)
        assert got == want
