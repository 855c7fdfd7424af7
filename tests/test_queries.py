"""Every query with SQL beside it gives the same rows in DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest
import small_repository
from lodestone.plans import code, hosting  # noqa: F401 - add their queries
from lodestone.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else str(v) if not isinstance(v, float) else f"{v:.6g}" for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, con, name):
    compare(plans.QUERIES[name](spark, SF).toPandas(), con.sql(plans.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(small_repository.SQL))
def test_small_repository(spark, con, name):
    compare(small_repository.QUERIES[name](spark, SF).toPandas(), con.sql(small_repository.SQL[name]).df())


def compare(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if str(want[c].dtype).startswith("datetime") or str(got[c].dtype).startswith("datetime"):
            got[c], want[c] = got[c].astype("datetime64[us]"), want[c].astype("datetime64[us]")
        elif want[c].dtype.kind in "iu" or got[c].dtype.kind == "f" and want[c].isna().any() or str(want[c].dtype).startswith("Int"):
            got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
