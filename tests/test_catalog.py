"""Every query with a SQL twin gives the same rows as DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from attestor.plans import catalog

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    return ("nan" if math.isnan(value) else round(value, 6)) if isinstance(value, float) else value


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, str(DATA))
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
