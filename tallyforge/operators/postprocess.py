"""Caps, floors and refills of predictions, in their fixed order."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.windows import PAIR, in_window


def daily_caps(sales: DataFrame, cutoff: datetime.date, multiplier: float = 2.0, horizon: int = 31, days: int = 90) -> DataFrame:
    """location, item_id, max_monthly_cap: the largest day total of the window, scaled to the horizon."""
    kept = sales.where(in_window(F.col("sale_date"), cutoff, days)).groupBy(*PAIR, "sale_date").agg(F.sum("quantity").alias("q"))
    return kept.groupBy(*PAIR).agg((F.max("q").cast("double") * horizon * multiplier).alias("max_monthly_cap"))


def cap_predictions(predictions: DataFrame, caps: DataFrame) -> DataFrame:
    """Predictions at most their cap; without a cap at most 3 times the largest prediction of all, which is one
    scalar of the table and never binds a positive one."""
    rows = predictions.join(caps, PAIR, "left")
    value = F.greatest(F.coalesce("prediction", F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("prediction", F.when(F.col("max_monthly_cap").isNotNull(), F.least(value, F.col("max_monthly_cap"))).otherwise(value)).select(*predictions.columns)


def floor_predictions(predictions: DataFrame, floor: float = 0.5) -> DataFrame:
    return predictions.withColumn("prediction", F.when(F.col("prediction") < floor, 0.0).otherwise(F.col("prediction")))


def refill_from_carts(predictions: DataFrame, engagement: DataFrame, horizon: int = 31) -> DataFrame:
    """A prediction of 0 with cart events in the last 7 days becomes their number over the horizon times the
    conversion rate between 0 and 1. engagement: pair, atc_count_7d, atc_to_purchase_rate_28d; joined on its keys."""
    keys = [k for k in PAIR if k in engagement.columns]
    rows = predictions.join(engagement.select(*keys, "atc_count_7d", "atc_to_purchase_rate_28d"), keys, "left")
    rate = F.least(F.greatest(F.coalesce("atc_to_purchase_rate_28d", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    refill = F.col("atc_count_7d").cast("double") * (horizon / 7.0) * rate
    hit = (F.col("prediction") == 0) & (F.coalesce("atc_count_7d", F.lit(0)) > 0)
    return rows.withColumn("prediction", F.when(hit, refill).otherwise(F.col("prediction"))).select(*predictions.columns)


def count_floored(predictions: DataFrame, floor: float = 0.5) -> DataFrame:
    """How many predictions the floor takes: above 0 and below it."""
    p = F.col("prediction")
    return predictions.agg(F.count_if((p > 0) & (p < floor)).alias("n_floored"))


def apply_scales(predictions: DataFrame, scales: DataFrame, group: str) -> DataFrame:
    """location, item_id, prediction: multiplied by the scale of the row's group; scales has a row per group, a group without
    one keeps its predictions. How the join is done is left to Spark's size rules."""
    rows = predictions.join(scales.select(group, "group_scale"), group, "left")
    return rows.select(*PAIR, F.greatest(F.col("prediction") * F.coalesce("group_scale", F.lit(1.0)), F.lit(0.0)).alias("prediction"))
