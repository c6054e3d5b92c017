"""The queries of the subpackage give what their SQL gives on the test tables."""

from pathlib import Path

import duckdb
import pytest

from chronogrid.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = queries.queries()[name](spark, str(DATA))
    found = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    assert columns == sorted(df.columns)
    order = [c[0] for c in found.description]
    want = sorted(str([dict(zip(order, r, strict=True))[c] for c in columns]) for r in found.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want and want
