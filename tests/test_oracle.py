"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
SLOW = ("op", "pipeline")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(SLOW)])
def test_equals_sql(spark, duck, name):
    import pandas as pd

    a, b = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
