import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyforge.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    rows = Q.QUERIES[name](spark, FOLDER).collect()
    assert rows
    if name in Q.SQL:
        c = duckdb.connect()
        for t in os.listdir(FOLDER):
            c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{FOLDER}/{t}'")
        assert sorted(map(tuple, rows)) == sorted(c.execute(Q.SQL[name]).fetchall())


def test_registered():
    assert set(Q.QUERIES) <= set(entry.queries())
