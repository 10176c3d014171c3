"""The forecasting job as named stages, each a table or a model in one folder: what is there isn't built again."""

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import baselines as B
from tallyforge.operators import cubes as C
from tallyforge.operators import models as MO
from tallyforge.operators import monthly as M
from tallyforge.operators import postprocess as P
from tallyforge.operators import quality as Q
from tallyforge.operators import sampling as S
from tallyforge.operators import scoring as E
from tallyforge.operators import tuning as G
from tallyforge.plans.demand_queries import PAIR, Schema
from tallyforge.sources import sinks as K
from tallyforge.sources.tables import exists

STAGES = ("aggregate", "features", "train", "final", "predict")
MODES = ("none", "inv_y", "inv_sqrt_y")


class Pipeline:
    """aggregate: month cubes and items; features: one frame for all target months, so that codes agree; train: a model for each
    weight mode and one of the log target, stopped early on the last known month, its candidates tuned; final: each fitted again on
    all months with the rounds it took; predict: the best candidate for the month after, checked and written."""

    def __init__(self, spark: SparkSession, data: str, folder: str, schema: Schema, trees: int = 20, max_rows: int = 0, ratio: float | None = None, zero_weight: float = 1.0, force: bool = False) -> None:
        self.spark, self.data, self.folder, self.s = spark, data, folder.rstrip("/"), schema
        self.trees, self.max_rows, self.ratio, self.zero_weight, self.force = trees, max_rows, ratio, zero_weight, force
        self.stages = K.Stages(spark, self.folder)

    def _run(self, name: str, build: Callable[[], DataFrame], version: str | None = None) -> DataFrame:
        return self.stages.run(name, build, self.force, version)

    def aggregate(self) -> None:
        spark, d, s = self.spark, self.data, self.s
        self._run("months", lambda: C.sales_months(s.sales(spark, d), s.start, s.target))
        self._run("events", lambda: C.engagement_months(s.engagement(spark, d), s.start, s.target))
        self._run("items", lambda: s.items(spark, d))

    def features(self) -> None:
        s, read = self.s, self.stages.read
        frame = self._run("frame", lambda: M.monthly_frame(read("months"), read("events"), read("items"), [*s.targets, s.target + 1], s.start))
        known = frame.where(F.col("t") < s.target)
        self._run("train", lambda: S.sample_months(known, self.max_rows, "t", [*PAIR, "t"], ratio=self.ratio) if self.max_rows or self.ratio is not None else known)
        self._run("valid", lambda: frame.where(F.col("t") == s.target))
        self._run("next", lambda: frame.where(F.col("t") == s.target + 1))

    def _model(self, name: str, build: Callable[[], object]) -> object:
        at = f"{self.folder}/models/{name}"
        if self.force or not exists(self.spark, f"{at}/metadata/_SUCCESS"):
            MO.save_model(build(), at)
        return MO.load_model(at)

    def _predicted(self, models: dict[str, object], df: DataFrame, names: list[str]) -> DataFrame:
        """df's keys with a column pred_<name> for each model, the weighted baseline and the recent mean, in one pass."""
        out = df
        for name, model in models.items():
            out = MO.with_prediction(model, out, names, f"pred_{name}", log=name == "log")
        return out.select(*PAIR, *(f"pred_{n}" for n in models), F.col("baseline_weighted").alias("pred_base"), F.col("li_qty_roll_mean_3").alias("recent"))

    def _fit(self, mode: str, rows: DataFrame, names: list[str], **kw: object) -> object:
        return MO.fit_raw(rows, names, weights="inv_y" if mode == "log" else mode, zero_weight=self.zero_weight, log=mode == "log", **kw)

    def train(self) -> None:
        train, valid = self.stages.read("train"), self.stages.read("valid")
        names = MO.feature_names(train)
        models = {m: self._model(f"valid_{m}", lambda m=m: self._fit(m, train, names, trees=self.trees, valid=valid)) for m in (*MODES, "log")}
        preds = self._run("valid_predictions", lambda: self._predicted(models, valid, names))
        columns = [c for c in preds.columns if c not in PAIR]
        rows = self._run("scored", lambda: E.evaluation_rows(M.with_status(self.stages.read("months"), self.stages.read("items")), preds, self.s.target, columns))
        grouped = rows.withColumn("activity", E.activity_group(F.col("recent")))
        table, scales = G.scale_candidates(grouped, {m: f"pred_{m}" for m in MODES}, "pred_log", "pred_base", "activity", E.ACTIVITY)
        self._run("candidates", lambda: table)
        self._run("group_scales", lambda: scales)
        best = self.stages.read("candidates").orderBy(F.round("mape_quantity", 9).asc_nulls_last(), F.round("mae_quantity", 9), "candidate").first()
        choice = best.asDict() | {"features": names, "trees": {m: model.getNumTrees for m, model in models.items()}}
        K.write_json(self.spark, f"{self.folder}/choice.json", choice)
        parts = {"Candidates": self.stages.read("candidates").orderBy("mape_quantity", "mae_quantity"), "Group scales": self.stages.read("group_scales"), "Errors by target": G.compare_runs(rows, [f"pred_{m}" for m in (*MODES, "log")]).orderBy("model", "target_group"), "Training rows": S.diagnostic(train).orderBy("t")}
        K.write_report(self.spark, f"{self.folder}/report.md", parts)

    def _choice(self) -> dict:
        choice = K.read_json(self.spark, f"{self.folder}/choice.json")
        if not choice:
            raise ValueError("run the stage train first")
        return choice

    def final(self) -> None:
        choice = self._choice()
        rows = self.stages.read("train").unionByName(self.stages.read("valid"))
        for mode, trees in choice["trees"].items():
            self._model(f"final_{mode}", lambda m=mode, n=trees: self._fit(m, rows, choice["features"], trees=max(5, n)))

    def predict(self) -> None:
        choice, mode = self._choice(), self._choice()["weight_mode"]
        models = {m: MO.load_model(f"{self.folder}/models/final_{m}") for m in (*MODES, "log")}
        preds = self._run("next_predictions", lambda: self._predicted(models, self.stages.read("next"), choice["features"]), version=f"{choice['trees']}")
        value = G.fixed_blends(f"pred_{mode}", "pred_log", "pred_base")[choice["blend_mode"]]
        rows = preds.select(*PAIR, value.alias("prediction"), E.activity_group(F.col("recent")).alias("group"))
        if choice["postprocess"] == "group_scale":
            scaled = P.apply_scales(rows, self.stages.read("group_scales").where(F.col("weight_mode") == mode), "group")
        else:
            scaled = rows.select(*PAIR, (F.col("prediction") * choice["scale"]).alias("prediction"))
        items = self.stages.read("items")
        out = self._run("output", lambda: K.output_frame(B.zero_where_status(scaled, items)), version=f"{choice['candidate']} {choice['trees']}")
        K.write_csv(out, f"{self.folder}/output.csv")
        self._run("output_check", lambda: Q.check_output(out, items), version=f"{datetime.datetime.now()}")

    def run(self, stage: str) -> dict[str, bool]:
        """One stage, or all; status runs none. What tables there are then."""
        for name in STAGES if stage == "all" else () if stage == "status" else (stage,):
            getattr(self, name)()
        return self.stages.status(["months", "events", "items", "frame", "train", "valid", "next", "valid_predictions", "scored", "candidates", "group_scales", "next_predictions", "output", "output_check"])
