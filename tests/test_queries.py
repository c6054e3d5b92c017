"""Every registered query runs; with SQL, it gives what DuckDB gives on the same files."""

import math
from pathlib import Path

import duckdb
import pytest

from chronogrid.plans import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: "" if x is None or (isinstance(x, float) and math.isnan(x)) else repr(float(x)) if isinstance(x, (int, float)) else str(x)
    return sorted(tuple(clean(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, str(DATA))
    got = rows(df.columns, df.collect())
    assert got
    if name in queries.oracle_sql():
        found = con.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, found.fetchall())
