"""Scoring: truth, evaluation universe, error metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6
PAIR = ["location", "item_id"]


def evaluation_rows(cube: DataFrame, predictions: DataFrame, target: int, columns: list[str], price: DataFrame | None = None) -> DataFrame:
    """All known pairs of cube (whole history and target) in locations with sales in the target month, with
    y_true, revenue_true and the prediction columns, clipped at 0, 0 where a pair has none. cube holds kept items only."""
    truth = cube.groupBy(*PAIR).agg(F.sum(F.when(F.col("m") == target, F.col("qty")).otherwise(0)).cast("double").alias("y_true"), F.sum(F.when(F.col("m") == target, F.col("rev")).otherwise(0)).cast("double").alias("revenue_true"))
    active = cube.where((F.col("m") == target) & (F.col("qty") > 0)).select("location").distinct()
    rows = truth.join(active, "location", "left_semi").join(predictions.select(*PAIR, *columns), PAIR, "left")
    if price is not None:
        rows = rows.join(price, "item_id", "left")
    return rows.withColumns({c: F.greatest(F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) for c in columns})


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mape(y: Column, p: Column, eps: float = EPS) -> Column:
    """In percent, over positive truths only; null if there are none."""
    return F.avg(F.when(y > 0, F.abs(y - p) / F.greatest(F.abs(y), F.lit(eps)))) * 100


def evaluate(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row of errors over the truth's pairs (location, item_id, sales, revenue); a missing prediction is 0, revenue
    is predicted with the mean of the item's average prices."""
    unit = truth.withColumn("__u", F.try_divide(F.col("revenue"), F.col("sales"))).groupBy("item_id").agg(F.avg("__u").alias("__price"))
    rows = truth.join(predictions, PAIR, "left").join(unit, "item_id", "left")
    p = F.greatest(F.coalesce(F.col("prediction"), F.lit(0.0)), F.lit(0.0))
    earned = p * F.coalesce("__price", F.lit(0.0))
    return rows.agg(mae(F.col("sales"), p).alias("mae_sales"), mape(F.col("sales"), p).alias("mape_sales"), mae(F.col("revenue"), earned).alias("mae_revenue"), mape(F.col("revenue"), earned).alias("mape_revenue"))


TARGET_GROUPS = ["y=0", "0<y<=1", "1<y<=5", "y>5"]
ACTIVITY = ["very_low", "low", "mid", "high", "very_high"]
ACTIVITY_THREE = ["low", "mid", "high"]


def named(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """df with a row for each of the names, nulls where it has none."""
    return df.sparkSession.createDataFrame([(n,) for n in names], f"{column} string").join(df, column, "left")


def group_metrics(rows: DataFrame, prediction: str) -> DataFrame:
    """Pairs and errors by target group; a group without pairs has 0 and nulls."""
    y, p = F.col("y_true"), F.col(prediction)
    per = rows.groupBy(target_group(y).alias("target_group")).agg(F.count(F.lit(1)).alias("n_pairs"), mae(y, p).alias("mae_quantity"), mape(y, p).alias("mape_quantity"))
    return named(per, "target_group", TARGET_GROUPS).fillna(0, ["n_pairs"])


def output_statistics(p: Column) -> list[Column]:
    """Least, greatest and mean prediction, and how many are zero and above."""
    return [F.count(F.lit(1)).alias("n_rows"), F.min(p).alias("least"), F.max(p).alias("greatest"), F.avg(p).alias("mean"), F.count_if(p == 0).alias("zeros"), F.count_if(p > 0).alias("nonzero")]


def universe_summary(cube: DataFrame, items: DataFrame, target: int) -> DataFrame:
    """One row on the pairs that could be predicted for a month: those seen before it, those whose item's status drops them, and
    the kept ones with their locations and items. Pairs are reduced to one row before anything distinct is counted."""
    pairs = cube.where(F.col("m") < target).groupBy(*PAIR).agg(F.sum("qty").alias("__q")).where(F.col("__q") > 0)
    status = F.coalesce("sale_status", F.lit(0))
    known = pairs.join(items.select("item_id", status.alias("__status")), "item_id", "left").select(*PAIR, F.coalesce("__status", F.lit(1)).alias("__status"))
    kept = F.col("__status") != 0
    by_item = known.groupBy("item_id").agg(F.count(F.lit(1)).alias("a"), F.count_if(kept).alias("b")).agg(F.sum("a").alias("seen_pairs"), F.sum("b").alias("kept_pairs"), F.count_if(F.col("b") > 0).alias("active_items"))
    places = known.where(kept).groupBy("location").count().agg(F.count(F.lit(1)).alias("active_locations")).scalar()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return by_item.select(zero("seen_pairs").alias("seen_pairs"), zero("kept_pairs").alias("kept_pairs"), (zero("seen_pairs") - zero("kept_pairs")).alias("status_zero_pairs"), places.alias("active_locations"), "active_items")


def target_group(y: Column) -> Column:
    return F.when(y <= 0, "y=0").when(y <= 1, "0<y<=1").when(y <= 5, "1<y<=5").otherwise("y>5")


def activity_group(recent: Column, refined: bool = True) -> Column:
    """Right-closed groups of recent activity: five, or the three older ones."""
    if refined:
        return F.when(recent <= 0.5, "very_low").when(recent <= 1, "low").when(recent <= 5, "mid").when(recent <= 20, "high").otherwise("very_high")
    return F.when(recent <= 1, "low").when(recent <= 5, "mid").otherwise("high")


def distribution(p: Column) -> list[Column]:
    share = lambda x: (F.avg((p < x).cast("double")) * 100)
    return [F.avg(p).alias("mean_prediction"), F.min(p).alias("min_prediction"), share(0.1).alias("below_0_1"), share(0.5).alias("below_0_5"), share(1.0).alias("below_1_0")]


def long_predictions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The prediction columns as rows: model, prediction."""
    return rows.unpivot([c for c in rows.columns if c not in columns], columns, "model", "prediction")
