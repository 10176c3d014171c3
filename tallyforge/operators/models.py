"""Models over feature frames, from Spark's own library: a different model class than boosted trees of other
libraries, so numbers differ; the interface (weights, log target, two stages, importance) is the same."""

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.boosting import fit_weighted
from tallyforge.operators.sampling import row_weight

NOT_FEATURES = {"location", "item_id", "category", "brand", "t", "target", "target_revenue"}


def feature_names(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if c not in NOT_FEATURES and k in ("int", "bigint", "double", "float")]


def aligned(df: DataFrame, names: list[str]) -> DataFrame:
    """df with all the named features: missing ones 0, nulls 0."""
    return df.select(*(c for c in df.columns if c not in names), *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if n in df.columns else F.lit(0.0).alias(n) for n in names))


def alignment(train: list[str], score: list[str]) -> list[str]:
    """Warnings on features that only one of two frames has: missing ones are scored as 0, further ones not at all."""
    return [f"missing in scoring: {c}" for c in train if c not in score] + [f"unknown to the model: {c}" for c in score if c not in train]


def _vectors(df: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="__x", handleInvalid="keep").transform(aligned(df, names))


def fit_raw(df: DataFrame, names: list[str], weights: str = "inv_y", zero_weight: float = 1.0, trees: int = 20, depth: int = 4, seed: int = 42, log: bool = False, valid: DataFrame | None = None) -> Model:
    """Boosted trees on the target (absolute loss) or on its log1p (squared loss). With valid rows boosting stops once their
    error no longer falls."""
    y = F.log1p("target") if log else F.col("target")
    data = df if valid is None else df.withColumn("__valid", F.lit(False)).unionByName(valid.withColumn("__valid", F.lit(True)))
    rows = _vectors(data.withColumn("__w", row_weight(F.col("target"), weights, zero_weight)).withColumn("__y", y), names)
    model = GBTRegressor(featuresCol="__x", labelCol="__y", weightCol="__w", lossType="squared" if log else "absolute", maxIter=trees, maxDepth=depth, seed=seed)
    return (model if valid is None else model.setValidationIndicatorCol("__valid")).fit(rows)


def refit(model: Model, df: DataFrame, names: list[str], least: int = 5, **kw: object) -> Model:
    """A model fitted again on other rows with the rounds it took (least at the least), without validation."""
    return fit_raw(df, names, trees=max(least, model.getNumTrees), **kw)


def save_model(model: Model, path: str) -> None:
    """Written by Spark's own model writer, to any file system executors share."""
    model.write().overwrite().save(path)


def load_model(path: str) -> Model:
    return GBTRegressionModel.load(path)


def weighted_finals(train: DataFrame, valid: DataFrame, score: DataFrame, names: list[str], folder: str, modes: tuple[str, ...] = ("none", "inv_y", "inv_sqrt_y"), trees: int = 20) -> DataFrame:
    """location, item_id, t, weight_mode, prediction: a model for each weight mode, stopped early on valid, then fitted again on
    train and valid with the rounds it took, saved under folder and loaded for scoring. All modes are fitted in the same passes over
    binned rows, and score is made once for all of them."""
    weights = {mode: row_weight(F.col("target"), mode) for mode in modes}
    scored, shown = _vectors(score, names), []
    for mode, model in fit_weighted(aligned(train, names), aligned(valid, names), names, weights, trees, least=5).items():
        save_model(model, f"{folder}/{mode}")
        scored = load_model(f"{folder}/{mode}").setFeaturesCol("__x").setPredictionCol(f"__{mode}").transform(scored)
        shown.append(F.struct(F.greatest(F.nanvl(f"__{mode}", F.lit(0.0)), F.lit(0.0)).alias("prediction"), F.lit(mode).alias("weight_mode")))
    keys = [c for c in ("location", "item_id", "t") if c in score.columns]
    return scored.select(*keys, F.explode(F.array(*shown)).alias("__p")).select(*keys, "__p.*")


def fit_linear(df: DataFrame, names: list[str], family: str = "poisson") -> Model:
    """poisson or tweedie (power 1.5) with a log link."""
    more = {"variancePower": 1.5, "linkPower": 0.0} if family == "tweedie" else {"link": "log"}
    return GeneralizedLinearRegression(featuresCol="__x", labelCol="target", family=family, regParam=0.01, maxIter=25, **more).fit(_vectors(df, names))


def with_prediction(model: Model, df: DataFrame, names: list[str], column: str, log: bool = False) -> DataFrame:
    """df with the model's prediction, not below 0, as a further column: several models score in one pass, without joins."""
    rows = df.select("*", F.struct(*df.columns).alias("__row"))
    out = model.transform(_vectors(rows, names))
    p = F.expm1("prediction") if log else F.col("prediction")
    return out.select("__row.*", F.greatest(F.nanvl(p, F.lit(0.0)), F.lit(0.0)).alias(column))


def predict(model: Model, df: DataFrame, names: list[str], log: bool = False, name: str = "prediction") -> DataFrame:
    """df's keys with the prediction, not below 0; partitions are scored independently."""
    out = model.transform(_vectors(df, names))
    p = F.expm1("prediction") if log else F.col("prediction")
    keys = [c for c in ("location", "item_id", "t") if c in df.columns]
    return out.select(*keys, F.greatest(F.nanvl(p, F.lit(0.0)), F.lit(0.0)).alias(name))


def two_stage(train: DataFrame, score: DataFrame, names: list[str], trees: int = 10, depth: int = 4, seed: int = 42) -> DataFrame:
    """Chance of a sale times the expected quantity given one."""
    rows = _vectors(train.withColumn("__sold", (F.col("target") > 0).cast("double")), names)
    chance = GBTClassifier(featuresCol="__x", labelCol="__sold", maxIter=trees, maxDepth=depth, seed=seed).fit(rows)
    amount = GBTRegressor(featuresCol="__x", labelCol="target", maxIter=trees, maxDepth=depth, seed=seed).fit(rows.where("target > 0"))
    keys = [c for c in ("location", "item_id", "t") if c in score.columns]
    first = chance.transform(_vectors(score, names)).select(*keys, "__x", vector_to_array("probability")[1].alias("__p"))
    both = amount.transform(first)
    return both.select(*keys, F.greatest(F.col("__p") * F.col("prediction"), F.lit(0.0)).alias("prediction"))


def importance(spark: SparkSession, model: Model, names: list[str]) -> DataFrame:
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
