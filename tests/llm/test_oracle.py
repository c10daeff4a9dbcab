"""The queries of training-data operators against their SQL."""

import glob
import os

import duckdb
import pytest

from skein.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.sql(ORACLE[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(result.columns)
    theirs = sorted(tuple(r) for r in result.select(*[duckdb.ColumnExpression(c) for c in sorted(result.columns)]).fetchall())
    assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == theirs and theirs
