"""Every query with SQL against DuckDB on the smallest tables, and every other one for its rows."""

import glob
import os

import numpy as np
import pytest

from strandlake import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def table(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "ifu" or str(df[c].dtype) in ("Int64", "Int32"):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda x: None if x is None or x is np.nan else str(x)).astype(object)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got, want = table(registry.queries()[name](spark, DIR).toPandas()), table(con.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float and want[c].dtype == float:
            np.testing.assert_allclose(got[c], want[c], rtol=0, atol=2e-6)
        else:
            assert got[c].where(got[c].notna(), None).tolist() == want[c].where(want[c].notna(), None).tolist()


@pytest.mark.parametrize("name", sorted(set(registry.ALL) - set(SQL)))
def test_has_rows(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())
