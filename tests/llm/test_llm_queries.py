"""Queries of the subpackage against their SQL twins on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import verify
from locusframe.llm import queries

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, con, name):
    got = queries.QUERIES[name](spark, str(FOLDER))
    a = pd.DataFrame([tuple(r) for r in got.collect()], columns=got.columns, dtype=object)
    cur = con.execute(queries.ORACLE[name])
    b = pd.DataFrame(cur.fetchall(), columns=[x[0] for x in cur.description], dtype=object)
    assert sorted(a.columns) == sorted(b.columns) and verify.normal(a) == verify.normal(b)


def test_the_rest_runs(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLE)):
        queries.QUERIES[name](spark, str(FOLDER)).count()
