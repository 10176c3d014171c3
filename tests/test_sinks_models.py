import pytest
from pyspark.sql import functions as F

from tallyforge.operators import models as MO
from tallyforge.sources import sinks as K


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "007", 2.5), (2, "8", 0.0)], K.OUTPUT)
    K.write_csv(df, f"{tmp_path}/c", one_file=True)
    assert sorted(map(tuple, K.read_output_csv(spark, f"{tmp_path}/c").collect())) == [(1, "007", 2.5), (2, "8", 0.0)]
    for x in (1, 2):
        K.write_json(spark, f"{tmp_path}/a/b.json", {"x": x})
    assert K.read_json(spark, f"{tmp_path}/a/b.json") == {"x": 2} and K.read_json(spark, f"{tmp_path}/none") is None
    assert "| 007 |" in K.markdown(df, "t") and "The first 1 of 2 rows." in K.markdown(df, "t", 1)
    assert K.portal_frame(df).dtypes == [("location", "bigint"), ("item_id", "bigint"), ("quantity", "double")]
    odd = spark.createDataFrame([(1, "a", "x"), (1, "b", "-2"), (1, "c", None), (1, "d", "NaN"), (1, "e", "3")], "location int, item_id string, prediction string")
    assert {r.item_id: r.prediction for r in K.output_frame(odd).collect()} == {"a": 0.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 3.0}


def test_stages(spark, tmp_path):
    s, built = K.Stages(spark, str(tmp_path)), []
    build = lambda: built.append(1) or spark.range(3)
    with pytest.raises(ValueError):
        s.read("x")
    assert s.run("x", build).count() == 3 and s.run("x", build).count() == 3 and len(built) == 1
    assert s.run("x", build, force=True).count() == 3 and len(built) == 2 and s.status(["x", "y"]) == {"x": True, "y": False}
    for version, n in (("a", 3), ("a", 3), ("b", 4)):
        assert s.run("x", build, version=version).count() == 3 and len(built) == n


def test_models(spark):
    df = spark.range(400).select((F.col("id") % 5).cast("int").alias("location"), F.col("id").cast("string").alias("item_id"), F.lit(1).alias("t"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    df = df.withColumn("target", F.when(F.col("a") < 2, 0.0).otherwise(F.col("a") * 2))
    names = MO.feature_names(df)
    assert names == ["a", "b"]
    error = lambda p: df.join(p, ["location", "item_id", "t"]).agg(F.avg(F.abs(F.col("target") - F.col("prediction")))).first()[0]
    log = MO.fit_raw(df, names, trees=5, log=True)
    assert error(MO.predict(log, df, names, log=True)) < 1
    assert error(MO.two_stage(df, df, names, trees=3)) < 1
    assert MO.importance(spark, log, names).first().feature == "a"
    assert MO.predict(MO.fit_linear(df, names), df.drop("b"), names).count() == 400


def test_early_stop_refit_and_files(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 5).cast("int").alias("location"), F.col("id").cast("string").alias("item_id"), F.lit(1).alias("t"), (F.col("id") % 7).cast("double").alias("a"))
    df = df.withColumn("target", F.when(F.col("a") < 2, 0.0).otherwise(F.col("a") * 2))
    first = MO.fit_raw(df.where("location < 4"), ["a"], trees=15, valid=df.where("location = 4"))
    assert 1 <= first.getNumTrees <= 15
    again = MO.refit(first, df, ["a"], least=3)
    assert again.getNumTrees == max(3, first.getNumTrees)
    MO.save_model(again, f"{tmp_path}/m")
    rows = lambda m: sorted(map(tuple, MO.predict(m, df, ["a"]).collect()))
    assert rows(MO.load_model(f"{tmp_path}/m")) == rows(again)
    out = MO.weighted_finals(df.where("location < 4"), df.where("location = 4"), df, ["a"], str(tmp_path), ("none", "inv_y"), trees=3)
    assert {r.weight_mode: r.n for r in out.groupBy("weight_mode").agg(F.count(F.lit(1)).alias("n")).collect()} == {"none": 300, "inv_y": 300}
    assert MO.alignment(["a", "b"], ["b", "c"]) == ["missing in scoring: a", "unknown to the model: c"]


def test_scratch_tables_are_released(spark, tmp_path):
    from tallyforge.sources import tables as T

    df = T.settled(spark.range(5))
    path = T._scratch[-1]
    assert df.count() == 5 and T.exists(spark, path)
    T.release(spark)
    assert not T.exists(spark, path) and not T._scratch


def test_part_of_table(spark):
    from tallyforge.sources.tables import part_of_table, table

    d = "/root/testdata/sf0.001"
    n = table(spark, d, "lineitem").count()
    assert 0 < part_of_table(spark, d, "lineitem", 0.1).count() < n / 4
    assert part_of_table(spark, d, "lineitem", most_splits=1).count() <= n == part_of_table(spark, d, "lineitem").count()


def test_weighted_finals_are_sparks_trees_from_two_reads(spark, tmp_path):
    """Few distinct values, so candidates are the same: rounds and predictions have to be those of Spark's own trainer for each mode, but
    the rows are made twice (candidates, bins) instead of again and again for each fit, and score once."""
    df = spark.range(1500).select((F.col("id") % 5).cast("int").alias("location"), F.col("id").cast("string").alias("item_id"), F.lit(1).alias("t"), (F.col("id") * 7 % 31).cast("double").alias("a"), (F.col("id") * 13 % 17).cast("double").alias("b"), F.lit(3.0).alias("same"), (F.hash("id") % 7).cast("double").alias("c"))
    df = df.withColumn("target", F.greatest(F.lit(0.0), F.col("a") * 2 + F.col("b") * F.col("c") - 20)).withColumn("valid", F.col("item_id").cast("int") % 6 == 5).cache()
    names, made = ["a", "b", "same", "c"], spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    seen = df.mapInArrow(counted, df.schema)
    modes = ("none", "inv_y")
    out = MO.weighted_finals(seen.where("not valid").drop("valid"), seen.where("valid").drop("valid"), df.drop("valid"), names, str(tmp_path), modes, trees=7)
    got = {(r.weight_mode, r.item_id): r.prediction for r in out.collect()}
    assert len(got) == 3000 and made.value <= 4 * 1500  # two reads of either part
    for mode in modes:
        first = MO.fit_raw(df.where("not valid"), names, weights=mode, trees=7, valid=df.where("valid"))
        own, saved = MO.refit(first, df, names, weights=mode), MO.load_model(f"{tmp_path}/{mode}")
        assert saved.getNumTrees == own.getNumTrees and saved.featureImportances.toArray() == pytest.approx(own.featureImportances.toArray(), abs=1e-9)
        assert all(got[mode, r.item_id] == pytest.approx(r.prediction, abs=1e-9) for r in MO.predict(own, df, names).collect())


def test_split_candidates_of_many_values():
    import numpy as np

    from tallyforge.operators import boosting as BO

    rng = np.random.default_rng(1)
    values = np.concatenate([np.zeros(50_000), rng.random(50_000)])
    parts = [BO.squeezed(*np.unique(x, return_counts=True)) for x in np.split(rng.permutation(values), 10)]
    cuts = BO.thresholds(*BO.merged(parts))
    shares = np.bincount(np.searchsorted(cuts, values), minlength=32) / len(values)
    assert 25 <= len(cuts) <= 31 and cuts[0] > 0 and 0.48 < shares[0] < 0.53 and shares[1:].max() < 0.04
    assert BO.thresholds(np.array([1.0, 3.0, np.nan]), np.array([1, 1, 1])).tolist() == [2.0]
