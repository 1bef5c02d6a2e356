"""Queries through files, the store, named SQL and the simulator, against their SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from terralume.plans import queries, stored

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(stored.queries()))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.queries()[name](spark, SF)
    want = db.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    expected = sorted(map(repr, db.sql(f"select {', '.join(columns)} from want").fetchall()))
    assert rows == expected and rows
