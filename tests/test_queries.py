"""Every query with SQL, on the smallest tables, against DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from attesta import queries

HERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{HERE}/{name}.parquet'")
    return con


def normal(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "-"
        return f"{float(v):.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    df = df.reindex(sorted(df.columns), axis=1).astype(object).map(cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, HERE).toPandas()
    if name in queries.ORACLE_SQL:
        want = duck.execute(queries.ORACLE_SQL[name]).df()
        pd.testing.assert_frame_equal(normal(got), normal(want))
