"""Every formula against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from skyloom.plans import bindings

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region customer part orders lineitem events documents conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", bindings.queries())
def test_same_rows(spark, duck, name):
    frame = bindings.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    want = duck.execute(bindings.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    got = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in want.fetchall())
