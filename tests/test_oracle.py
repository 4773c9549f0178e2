"""Every query that SQL can express, against DuckDB; every other one runs."""

import glob
import os

import duckdb
import pytest

from lattica.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def tidy(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        assert tidy(map(tuple, got)) == tidy(want.select(*(f'"{c}"' for c in columns)).fetchall())
