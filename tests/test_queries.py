"""Every query against its SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

from millrace.plans import catalogue, flows

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.QUERIES | flows.QUERIES, catalogue.oracles() | flows.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver tables aren't here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    rows = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).astype(str).values))
    assert rows(got) == rows(want)


def test_entry_imports_without_a_session():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
