"""Every market query against its SQL in DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import decisions, market, reports, research, stores, studies  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def norm(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v

    return sorted((tuple(map(one, r)) for r in rows), key=lambda r: tuple((x is None, str(type(x)) if x is None else "", x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(market.QUERIES))
def test_query(spark, duck, name):
    df = market.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = norm(df.select(columns).collect())
    assert got
    if name not in market.SQL:
        return
    want = duck.sql(market.SQL[name])
    assert sorted(want.columns) == columns
    want = norm(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)), (name, a, b)
