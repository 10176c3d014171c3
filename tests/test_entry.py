"""Every query with SQL gives the rows of an independent engine on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CORE = {k: f for m in entry.MODULES if not m.__name__.startswith("tallyforge.llm") for k, f in m.QUERIES.items()}
SQL = {k: s for m in entry.MODULES if not m.__name__.startswith("tallyforge.llm") for k, s in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(FOLDER):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{FOLDER}/{t}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return str(v)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6))


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in SQL:
        assert rows
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns and len(rows) == len(want)
    assert all(same(x, y) for r, s in zip(rows, want) for x, y in zip(r, s))


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())
