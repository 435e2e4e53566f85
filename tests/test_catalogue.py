"""Every query of the engine against DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from tidewater import catalogue

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1e-6 * max(1, abs(b))
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert name in ORACLE
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE[name])
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    key = lambda r: [f"{v:.4e}" if isinstance(v, float) else repr(v) for v in r]
    a = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    b = sorted((tuple(r[k] for k in place) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    assert all(_close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_flagship_plan(spark):
    plan = catalogue.session(spark, DATA).explain(catalogue.FLAGSHIP)
    assert "PushedFilters: [IsNotNull(l_discount), GreaterThan(l_discount,0.05)" in plan
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan
