"""Queries do the whole job: all months, all features, the operators' own sizes."""

import re

import pytest
from pyspark.sql import functions as F
from test_entry import FOLDER

from tallyforge.operators import cubes as C
from tallyforge.operators import models as MO
from tallyforge.operators import monthly as M
from tallyforge.operators import skew
from tallyforge.operators import windows as W
from tallyforge.plans import data_queries as DQ
from tallyforge.plans import demand_queries as Q


def test_models_train_on_all_months_and_features(spark):
    train, score, names = Q._models(spark, FOLDER)
    assert [r.t for r in train.select("t").distinct().orderBy("t").collect()] == list(range(Q.STAR.start + 3, Q.STAR.target))
    assert [r.t for r in score.select("t").distinct().collect()] == [Q.STAR.target]
    assert names == MO.feature_names(train) and len(names) == 136
    assert {"item_rev_lag1", "view_item_lag1", "cat_qty_lag1", "brand_qty_lag1", "month_sin", "atc_to_view_lag1", "item_code"} <= {*names}


def test_models_have_the_default_trees(spark, monkeypatch):
    seen, fit = [], MO.GBTRegressor.fit
    monkeypatch.setattr(MO.GBTRegressor, "fit", lambda self, rows: seen.append(self.getMaxIter()) or fit(self.setMaxIter(1), rows))
    monkeypatch.setattr(MO.GBTClassifier, "fit", lambda self, rows, f=MO.GBTClassifier.fit: seen.append(self.getMaxIter()) or f(self.setMaxIter(1), rows))
    for name in ("gbt_raw", "gbt_log", "two_stage", "feature_importance"):
        Q.QUERIES[name](spark, FOLDER)
    assert seen == [20, 20, 10, 10, 20]


@pytest.mark.parametrize("name", ["training_frames_multi_target", "sample_weights", "sampling_diagnostic", "sample_month_counts", "training_frames_multi_target_2025"])
def test_all_months(spark, name):
    schema = Q.PURCHASES if name.endswith("_2025") else Q.STAR
    months = {r.t for r in Q.QUERIES[name](spark, FOLDER).select("t").distinct().collect()}
    assert months == set(range(schema.start + 3, schema.target + 1)) and len(months) == 9


@pytest.mark.parametrize("name,tables", [("classic_features", {"lineitem": 1}), ("monthly_features", {"lineitem": 1, "part": 1})])
def test_fact_tables_are_read_once(spark, monkeypatch, name, tables):
    """Whatever a query writes and returns: how often its plans scan a table."""
    plans, write = [], Q.settled

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    for module in (Q, M, W, C):
        if hasattr(module, "settled"):
            monkeypatch.setattr(module, "settled", seen)
    df = Q.QUERIES[name](spark, FOLDER)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    scans = "\n".join(plans)
    for t, n in tables.items():
        assert scans.count(f"{t}.parquet") == n


def test_samples_take_all_months(spark):
    months = set(range(Q.STAR.start + 3, Q.STAR.target + 1))
    for name in ("sample_positive_first", "sample_negative_ratio"):
        assert {r.t for r in Q.QUERIES[name](spark, FOLDER).select("t").distinct().collect()} == months


@pytest.mark.parametrize("name,keys", [("p5_found", ["field", "key_value"]), ("p5_items", ["item_id"]), ("p5_locations", ["location"])])
def test_hot_keys_and_repeated_rows_reach_several_salts(spark, monkeypatch, name, keys):
    seen, salted = [], skew.salted
    monkeypatch.setattr(skew, "salted", lambda *a: seen.append(salted(*a)) or seen[-1])
    DQ.QUERIES[name](spark, FOLDER).collect()
    marked = seen[0].cache()
    spread = F.countDistinct("__salt").alias("salts")
    hot = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), spread).where("n >= 200").collect()
    assert hot and all(r.salts >= 16 for r in hot)
    equal = marked.groupBy(*(c for c in marked.columns if c not in ("__salt", "__row"))).agg(spread)
    assert equal.where("salts > 1").count() > 0
    marked.unpersist()
    sales = DQ._sales(spark, FOLDER, "__position")
    assert sales.select("__position").distinct().count() == sales.count()


def test_p3_has_every_day_for_every_pair(spark):
    rows = DQ.QUERIES["p3_rolling"](spark, FOLDER)
    r = rows.agg(F.count(F.lit(1)), F.count_distinct("location", "item_id"), F.datediff(F.max("day"), F.min("day")) + 1).first()
    assert r[0] == r[1] * r[2] and next(n for n in DQ.QUERIES if n.startswith("p3_")) == "p3_rolling"


def test_p3_reads_what_it_needs_and_gives_no_nulls(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = DQ.QUERIES["p3_rolling"](spark, FOLDER)
        code = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert not any(f.nullable for f in rows.schema)
    assert "_metadata" not in code.split("Generated code:")[0]
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000  # longer methods aren't compiled by the JVM
