"""The registered queries on the smallest tables: columns, repeatability, and equality with their SQL."""

import glob
import os

import pytest

from pelorus.llm import queries as llm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
COLUMNS = {
    "p3_found": [("llm_request_id", "string"), ("defect", "string")], "p5_found": [("agent_task_id", "string"), ("reason", "string")], "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_no_repeated_cases(spark, name):
    df = llm.queries()[name](spark, DATA)
    assert df.dtypes == COLUMNS[name]
    rows = [repr(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = llm.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    found = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns and got == want
