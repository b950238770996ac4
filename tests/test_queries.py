"""Every query against its oracle SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from parlance.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLES:
        assert got
        return
    want = duck.execute(registry.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    assert columns == sorted(df.columns)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    rows = [tuple(plain(r[i]) for i in place) for r in want.fetchall()]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got), key=str) == sorted(rows, key=str)
