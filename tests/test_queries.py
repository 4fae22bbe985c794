"""Every registered query of the engine against its SQL, at sf0.001."""

import glob
import os

import duckdb
import pytest

from horncast.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == names
    rows = sorted(tuple(r) for r in got.select(*names).collect())
    assert rows == sorted(want.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())
