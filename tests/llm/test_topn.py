import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm.topn import best_rows, salted_top_n


@pytest.mark.parametrize("salts", [1, 7])
@pytest.mark.parametrize("n", [0, 1, 5])
def test_top_n_equals_sort(spark, salts, n):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.4 else r.choice([None, "a", "b", "c"]), r.choice([None, 1, 2, 3, 50]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, score int, id int").withColumn("salt", F.lit(1))
    got = salted_top_n(df, ["g"], [F.col("score").desc_nulls_last(), F.col("id").asc()], ["id"], n, salts=salts)
    by = {}
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        by |= {(g, i + 1): x[2] for i, x in enumerate(own[:n])}
    assert {(x.g, x["rank"]): x.id for x in got.collect()} == by and "salt" in got.columns


def test_equal_rows_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 1)] * 9, "g string, score int, id int")
    assert salted_top_n(df, ["g"], [F.col("score").desc(), F.col("id")], ["id"], 5).count() == 5
    assert salted_top_n(df.limit(0), ["g"], [F.col("id")], ["id"], 5).count() == 0


def test_best_rows(spark):
    df = spark.createDataFrame([("a", 5, None), ("a", 5, 3), ("a", 5, 9), ("a", 4, 99), ("b", 1, None), (None, 2, 1)], "k string, price int, at int")
    assert {tuple(x) for x in best_rows(df, ["k"], "price", "at").collect()} == {("a", 5, 9), ("b", 1, None), (None, 2, 1)}
