"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from skein.plans.oracle import ORACLE
from skein.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, columns):
    number = lambda v: v if isinstance(v, (bool, str, type(None))) else round(float(v), 12)
    return sorted(repr(tuple(number(r[c]) for c in sorted(columns))) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(result.columns)
    theirs = [dict(zip(result.columns, r)) for r in result.fetchall()]
    assert plain([r.asDict() for r in df.collect()], df.columns) == plain(theirs, df.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0
