"""Rule baselines: month totals, scaled trailing sums, item averages, and the first of them that has a value."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.windows import PAIR, in_window


def last_month(cutoff: datetime.date) -> tuple[datetime.date, datetime.date]:
    """First day (included) and end (excluded) of the last whole month by the cutoff: the cutoff's own, if it is that month's last day."""
    following = cutoff + datetime.timedelta(days=1)
    end = following.replace(day=1)
    return (end - datetime.timedelta(days=1)).replace(day=1), end


def month_total(sales: DataFrame, cutoff: datetime.date) -> DataFrame:
    """Sales of the last whole month by the cutoff, as pred_lastmonth: a date range, which reaches the scan."""
    first, end = last_month(cutoff)
    kept = sales.where((F.col("sale_date") >= F.lit(first)) & (F.col("sale_date") < F.lit(end)))
    return kept.groupBy(*PAIR).agg(F.sum("quantity").cast("double").alias("pred_lastmonth"))


def scaled_trailing(sales: DataFrame, cutoff: datetime.date, days: tuple[int, ...], horizon: int = 31) -> DataFrame:
    """Trailing sums scaled to the horizon, all windows in one pass; null without rows in the window."""
    day, q = F.col("sale_date"), F.col("quantity")
    kept = sales.where(in_window(day, cutoff, max(days)))
    return kept.groupBy(*PAIR).agg(*((F.sum(F.when(in_window(day, cutoff, n), q)).cast("double") * horizon / n).alias(f"pred_rolling{n}d") for n in days))


def item_average(sales: DataFrame, cutoff: datetime.date, days: int = 90) -> DataFrame:
    """Mean quantity of an item's rows in the window."""
    kept = sales.where(in_window(F.col("sale_date"), cutoff, days)).groupBy("item_id")
    return kept.agg((F.sum("quantity").cast("double") / F.count("quantity")).alias("item_global_avg"))


def baseline(sales: DataFrame, cutoff: datetime.date) -> DataFrame:
    """location, item_id, prediction for all pairs: total of the last whole month, else 90, 56, 28 days, else the item's
    average, else 0. One pass over the pairs gives all sources; a negative value has no say."""
    day, q = F.col("sale_date"), F.col("quantity")
    days = (28, 56, 90)
    first, end = last_month(cutoff)
    sums = sales.groupBy(*PAIR).agg(
        F.sum(F.when((day >= F.lit(first)) & (day < F.lit(end)), q)).cast("double").alias("last"),
        *((F.sum(F.when(in_window(day, cutoff, n), q)).cast("double") * 31 / n).alias(f"r{n}") for n in days),
    )
    good = lambda c: F.when(F.col(c) >= 0, F.col(c))
    none = F.coalesce("last", "r90", "r56", "r28").isNull()
    rows = sums.join(item_average(sales, cutoff), "item_id", "left")
    value = F.when(none, F.coalesce("item_global_avg", F.lit(0.0))).otherwise(F.coalesce(good("last"), good("r90"), good("r56"), good("r28"), F.lit(0.0)))
    return rows.select(*PAIR, F.greatest(value, F.lit(0.0)).alias("prediction"))


def zero_where_status(predictions: DataFrame, items: DataFrame, status: int = 0) -> DataFrame:
    """Predictions of items with the status become 0; unlisted items keep theirs."""
    marked = items.where(F.col("sale_status") == status).select("item_id", F.lit(True).alias("__hit"))
    joined = predictions.join(marked, "item_id", "left")
    return joined.withColumn("prediction", F.when(F.col("__hit"), 0.0).otherwise(F.col("prediction"))).select(*predictions.columns)
