"""Commands over tables: python -m tallyforge COMMAND --help."""

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import models as MO
from tallyforge.operators import quality as Q
from tallyforge.operators import sampling as S
from tallyforge.operators import scoring as E
from tallyforge.operators import tuning as G
from tallyforge.plans.demand_queries import PURCHASES, STAR, Schema
from tallyforge.plans.pipeline import STAGES, Pipeline
from tallyforge.sources import sinks as K

SCHEMAS = {"star": STAR, "purchases": PURCHASES}
#: The prediction columns that are looked for, in order of preference, where none is named.
PREFERRED = ("pred_raw", "pred_inv_y", "pred_ensemble", "prediction", "pred_base")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return K.read_output_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def _predictions(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("pred")]


def _column(df: DataFrame, wanted: str | None) -> str:
    found = wanted or next((c for c in PREFERRED if c in df.columns), None)
    if found not in df.columns:
        raise SystemExit(f"no prediction column {wanted or PREFERRED} in {df.columns}")
    return found


def stages(spark: SparkSession, a: argparse.Namespace) -> int:
    schema: Schema = SCHEMAS[a.schema]
    for name, done in Pipeline(spark, a.data, a.folder, schema, a.trees, a.max_rows, a.negative_ratio, a.zero_weight, a.force).run(a.stage).items():
        print(f"{name}: {'done' if done else 'missing'}")
    return 0


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    df = spark.read.option("header", True).csv(a.path) if a.path.endswith(".csv") else spark.read.parquet(a.path)
    hints = Q.column_hints(df.columns)
    print("\n".join(hints))
    if a.normalize:
        df = Q.normalise_output(df)
        K.write_csv(df, a.normalize)
    elif hints:
        return 1
    df = df.withColumn("prediction", F.col("prediction").try_cast("double"))
    rows = Q.check_output(df, SCHEMAS[a.schema].items(spark, a.items) if a.items else None)
    print(K.markdown(rows, "Checks"), K.markdown(df.agg(*E.output_statistics(F.col("prediction"))), "Predictions"))
    return int(any(r.n for r in rows.collect()))


def sweep(spark: SparkSession, a: argparse.Namespace) -> int:
    df = _read(spark, a.path)
    column = _column(df, a.pred_col)
    top = G.scale_sweep(df, column, G.scale_values(a.start, a.stop, a.step)).orderBy(F.col("mape_quantity").asc_nulls_last(), "mae_quantity", "scale").limit(a.top_k)
    print(K.markdown(top, f"Scales of {column}"))
    if a.json_out:
        K.write_json(spark, a.json_out, {"pred_col": column, "best_scale": top.first().scale})
    return 0


def variants(spark: SparkSession, a: argparse.Namespace) -> int:
    best = a.best_scale if a.best_scale is not None else (K.read_json(spark, a.scale_json) or {}).get("best_scale", 1.0)
    df = _read(spark, a.path)
    K.write_parquet(G.prediction_variants(df, _column(df, a.pred_col), best, a.delta, a.control), a.out, ["variant"])
    return 0


def groups(spark: SparkSession, a: argparse.Namespace) -> int:
    df = _read(spark, a.path)
    df, column = df.withColumn("activity", E.activity_group(F.col("recent"), not a.three)), _column(df, a.pred_col)
    scales = G.group_scales(df, column, "activity", E.ACTIVITY_THREE if a.three else E.ACTIVITY, G.best_scale(df, column))
    print(K.markdown(scales, f"Group scales of {column}"))
    if a.json_out:
        K.write_json(spark, a.json_out, {r.activity: r.group_scale for r in scales.collect()})  # a row per group
    return 0


def candidates(spark: SparkSession, a: argparse.Namespace) -> int:
    df = _read(spark, a.path).withColumn("activity", E.activity_group(F.col("recent")))
    table, _ = G.scale_candidates(df, dict(m.split("=", 1) for m in a.mode), a.log, a.base, "activity", E.ACTIVITY)
    print(K.markdown(table.orderBy("mape_quantity", "mae_quantity"), "Candidates"), K.markdown(G.extra_choices(table), "Extra candidates"))
    return 0


def compare(spark: SparkSession, a: argparse.Namespace) -> int:
    parts = [G.compare_runs(df, _predictions(df)).withColumn("run", F.lit(tag)) for tag, df in ((t, _read(spark, p)) for t, p in (x.split("=", 1) for x in a.run))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    print(K.markdown(out.select("run", *(c for c in out.columns if c != "run")).orderBy("run", "model", "target_group"), "Runs"))
    return 0


def diagnostic(spark: SparkSession, a: argparse.Namespace) -> int:
    print(K.markdown(S.diagnostic(_read(spark, a.path)).orderBy("t"), "Training rows"))
    return 0


def two_stage(spark: SparkSession, a: argparse.Namespace) -> int:
    train, score = _read(spark, a.train), _read(spark, a.score)
    print("\n".join(MO.alignment(MO.feature_names(train), MO.feature_names(score))))
    K.write_parquet(MO.two_stage(train, score, MO.feature_names(train), a.trees), a.out)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tallyforge")
    sub = top.add_subparsers(dest="command", required=True)

    def command(f, *arguments: tuple) -> None:
        p = sub.add_parser(f.__name__.replace("_", "-"))
        p.set_defaults(run_command=f)
        for names, options in arguments:
            p.add_argument(*names.split(), **options)

    schema = ("--schema", {"choices": sorted(SCHEMAS), "default": "purchases"})
    column, path = ("--pred-col", {}), ("path", {})
    command(stages, ("stage", {"choices": ["status", *STAGES, "all"]}), ("--data", {"required": True}), ("--folder", {"required": True}), schema, ("--trees", {"type": int, "default": 20}), ("--max-rows", {"type": int, "default": 0}), ("--negative-ratio", {"type": float}), ("--zero-weight", {"type": float, "default": 1.0}), ("--force", {"action": "store_true"}))
    command(check, path, ("--normalize", {}), ("--items", {}), schema)
    command(sweep, path, column, ("--start", {"type": float, "default": 0.7}), ("--stop", {"type": float, "default": 1.15}), ("--step", {"type": float, "default": 0.025}), ("--top-k", {"type": int, "default": 10}), ("--json-out", {}))
    command(variants, path, column, ("--scale-json", {"default": ""}), ("--best-scale", {"type": float}), ("--delta", {"type": float, "default": 0.025}), ("--control", {}), ("--out", {"required": True}))
    command(groups, path, column, ("--three", {"action": "store_true"}), ("--json-out", {}))
    command(candidates, path, ("--mode", {"action": "append", "required": True, "help": "NAME=COLUMN"}), ("--log", {"default": "pred_log"}), ("--base", {"default": "pred_base"}))
    command(compare, ("--run", {"action": "append", "required": True, "help": "TAG=PATH"}))
    command(diagnostic, path)
    command(two_stage, ("train", {}), ("score", {}), ("out", {}), ("--trees", {"type": int, "default": 10}))
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    return a.run_command(spark or SparkSession.builder.appName("tallyforge").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
