"""The queries of this subpackage that SQL can express, against DuckDB, on the smallest tables."""

import os
from collections import Counter
from pathlib import Path

import pytest

from citelens.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    rel = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(rel.columns)
    mine = Counter(tuple(r) for r in df.select(*rel.columns).collect())
    assert mine == Counter(rel.fetchall())
