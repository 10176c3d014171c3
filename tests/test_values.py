import pytest
from pyspark.sql import functions as F

from tallyforge.functions import values as V

IDS = [
    ("81483229", "81483229"), ("000081483229", "81483229"), ("81483229.0", "81483229"), ("81483229.00", "81483229"), (" 81483229 ", "81483229"),
    ("'81483229", "81483229"), ('"81483229"', "81483229"), ("81483229\t", "81483229"), ("81483229 ", "81483229"), ("8.1483229E7", "81483229"),
    ("8.1483229E+07", "81483229"), ("81,483,229", "81483229"), ("８１４８", "8148"), ("0", "0"), ("000", "0"), ("12345678901234567890123", "12345678901234567890123"),
    ("", None), ("  ", None), ("-", None), ("N/A", None), ("#REF!", None), ("null", None), (None, None),
]
PRICES = [
    ("59000", 59000), ("59000.0", 59000), ("59000.00", 59000), ("4.5E+04", 45000), ("2E+06", 2000000), ("VND 59,000", 59000), ("1.234.567 đ", 1234567),
    ("1,234,567 ₫", 1234567), ("59000đ", 59000), ("-99,000", -99000), ("VND -99,000", -99000), ("-4.5E+04", -45000), ("-5000 ", -5000), ("1.000", 1000), ("12,00", 12), ("0", 0),
    ("1.000.000,00", 1000000), ("99999999999999999999999", (1 << 63) - 1), ("free", None), ("contact", None), ("NaN", None), ("Infinity", None), ("-", None), ("", None), (None, None), ("1.5E-01", 0),
]
TYPES = [("view_item", "view_item"), ("VIEW_ITEM", "view_item"), (" view item ", "view_item"), ("view-item", "view_item"), ("View_Item\t", "view_item"), ("", None), ("--", None), (None, None)]


@pytest.mark.parametrize("read,cases", [(V.item_key, IDS), (V.amount, PRICES), (V.token, TYPES)])
def test_values(spark, read, cases):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string").select("i", read(F.col("x")).alias("y")).collect()
    assert {cases[r.i][0]: r.y for r in rows} == dict(cases)


def test_location_and_action(spark):
    df = spark.createDataFrame([(-1, " Listed "), (0, "DELISTED"), (None, None)], "l int, a string")
    assert [tuple(r) for r in df.select(V.valid_location(F.col("l")), V.action(F.col("a"))).collect()] == [(None, "listed"), (0, "delisted"), (None, None)]


def test_number_order(spark):
    df = spark.createDataFrame([("10",), ("9",), ("100",)], "x string")
    assert [r.x for r in df.orderBy(*V.number_order(F.col("x"))).collect()] == ["9", "10", "100"]
