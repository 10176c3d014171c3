"""The stages from tables to a checked output, and the commands over what they leave."""

import pytest
from pyspark.sql import functions as F

from tallyforge import __main__ as commands
from tallyforge.plans.demand_queries import PURCHASES
from tallyforge.plans.pipeline import Pipeline
from tallyforge.sources import sinks as K

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("stages"))
    run = lambda stage: commands.main(["stages", stage, "--data", DATA, "--folder", at, "--trees", "2", "--max-rows", "1200", "--negative-ratio", "1"], spark)
    with pytest.raises(ValueError, match="first"):
        run("features")
    assert run("all") == 0 and run("status") == 0
    return at


def test_stages(spark, folder):
    p = Pipeline(spark, DATA, folder, PURCHASES)
    assert all(p.run("status").values())
    read = p.stages.read
    assert {r.t for r in read("train").select("t").distinct().collect()} == set(PURCHASES.targets[:-1]) and read("train").count() <= 1200
    assert [r.t for r in read("next").select("t").distinct().collect()] == [PURCHASES.target + 1]
    assert read("candidates").count() == 15 and read("group_scales").count() == 15
    assert read("output").count() == read("next").count() > 100 and not any(r.n for r in read("output_check").collect())
    assert K.read_output_csv(spark, f"{folder}/output.csv").count() == read("output").count()
    choice = K.read_json(spark, f"{folder}/choice.json")
    best = read("candidates").agg(F.min(F.round("mape_quantity", 9))).first()[0]
    assert round(choice["mape_quantity"], 9) == best and choice["candidate"]


def test_a_stage_is_not_built_again(spark, folder):
    p = Pipeline(spark, DATA, folder, PURCHASES)
    before = p.stages.read("months").inputFiles()
    p.run("aggregate")
    assert p.stages.read("months").inputFiles() == before


def test_commands(spark, folder, capsys):
    scored = f"{folder}/scored.parquet"
    run = lambda *a: commands.main(list(a), spark)
    assert run("sweep", scored, "--pred-col", "pred_inv_y", "--json-out", f"{folder}/scale.json", "--top-k", "3") == 0
    assert K.read_json(spark, f"{folder}/scale.json")["pred_col"] == "pred_inv_y"
    assert run("variants", scored, "--pred-col", "pred_inv_y", "--scale-json", f"{folder}/scale.json", "--control", "pred_base", "--out", f"{folder}/variants") == 0
    assert {r.variant for r in spark.read.parquet(f"{folder}/variants").select("variant").distinct().collect()} == {"raw", "best", "best_minus", "best_plus", "control"}
    assert run("groups", scored, "--pred-col", "pred_inv_y", "--three", "--json-out", f"{folder}/groups.json") == 0 and set(K.read_json(spark, f"{folder}/groups.json")) == {"low", "mid", "high"}
    assert run("candidates", scored, "--mode", "inv_y=pred_inv_y") == 0 and run("compare", "--run", f"a={scored}", "--run", f"b={scored}") == 0
    assert run("diagnostic", f"{folder}/train.parquet") == 0
    assert run("two-stage", f"{folder}/train.parquet", f"{folder}/next.parquet", f"{folder}/two", "--trees", "1") == 0
    assert run("check", f"{folder}/output.csv", "--items", DATA) == 0
    spark.createDataFrame([("1", "a", "x"), ("1", "a", "-3")], "location string, item_id string, quantity string").write.option("header", True).csv(f"{folder}/old.csv")
    assert run("check", f"{folder}/old.csv") == 1 and run("check", f"{folder}/old.csv", "--normalize", f"{folder}/new.csv") == 0
    assert "rename quantity to prediction" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run("sweep", scored, "--pred-col", "none")
