"""Every query with SQL against DuckDB on the same rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from tidemill.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t[: -len('.parquet')]} AS SELECT * FROM '{SF}/{t}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return repr(float(x)) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert rows
