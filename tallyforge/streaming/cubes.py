"""The day cube from a stream of sales: windows of one day under a watermark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_sales(arrivals: DataFrame, time: str = "updated_date", late: str = "30 days") -> DataFrame:
    """location, item_id, sale_date, quantity and n_rows per day, in update or append mode. Rows that come later than
    the watermark allows are dropped, all others give what the batch gives; null keys are left out."""
    read = arrivals.withColumn("__at", F.col(time).cast("timestamp")).dropna(subset=["__at", "location", "item_id"]).withWatermark("__at", late)
    days = read.groupBy(F.window("__at", "1 day"), "location", "item_id").agg(F.sum(F.coalesce(F.col("quantity"), F.lit(0)).cast("bigint")).alias("quantity"), F.count(F.lit(1)).alias("n_rows"))
    return days.select("location", "item_id", F.col("window.start").cast("date").alias("sale_date"), "quantity", "n_rows")
