"""The training-data queries that SQL can express, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from parlance.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)


def test_every_operator_has_one_query():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
