"""Normalised views: sales, items, engagement. From purchase tables with their own names, or from the star schema."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import values as V
from tallyforge.sources.tables import first_column, table

SHIFT_DAYS = 9192


def star_sales(spark: SparkSession, d: str) -> DataFrame:
    """location, item_id, sale_date, quantity, price: line items by region of the supplier. The date filter of a
    consumer reaches the scan, as sale_date is a plain cast."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    place = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").cast("int").alias("location"))
    return lines.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "location", F.col("l_partkey").cast("string").alias("item_id"), F.col("l_shipdate").cast("date").alias("sale_date"),
        F.col("l_quantity").cast("decimal(18,0)").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
    )


def star_items(spark: SparkSession, d: str) -> DataFrame:
    """item_id, category, brand, item_price, sale_status."""
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("item_price"), F.when(F.col("p_size") > 40, 0).otherwise(1).alias("sale_status"),
    )


def star_engagement(spark: SparkSession, d: str) -> DataFrame:
    """item_id, event_date, event_type, quantity."""
    kept = table(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    return kept.select(
        F.col("user_id").cast("string").alias("item_id"), F.date_sub(F.col("ts").cast("date"), SHIFT_DAYS).alias("event_date"),
        F.when(F.col("event_type") == "view", "view_item").otherwise("add_to_cart").alias("event_type"), F.lit(1).cast("decimal(18,0)").alias("quantity"),
    )


def purchase_sales(purchases: DataFrame) -> DataFrame:
    """sales from a purchase table: valid locations, items with an id, event type purchase. An unreadable price is null."""
    read = purchases.select(
        V.valid_location(F.col("location")).alias("location"), V.item_key(F.col("item_id")).alias("item_id"), F.col("updated_date").cast("date").alias("sale_date"),
        F.col("quantity").cast("decimal(18,0)").alias("quantity"), V.amount(F.col("price")).cast("decimal(20,2)").alias("price"), V.token(F.col("event_type")).alias("event_type"),
    )
    return read.where(F.col("event_type") == "purchase").drop("event_type").dropna(subset=["location", "item_id", "sale_date"])


def purchase_items(items: DataFrame) -> DataFrame:
    """One row per item of an item table, columns found by their usual names; the smallest row wins where an id
    is repeated (an explicit order instead of the order in the file); a null status becomes 0."""
    category, brand = first_column(items, "category_lv1", "category_l1", "category"), first_column(items, "brand", "manufacturer")
    read = items.select(
        V.item_key(F.col("item_id")).alias("item_id"), F.coalesce(F.col(category) if category else F.lit(None).cast("string"), F.lit("__missing__")).alias("category"),
        F.coalesce(F.col(brand) if brand else F.lit(None).cast("string"), F.lit("__missing__")).alias("brand"),
        V.amount(F.col("price")).cast("decimal(20,2)").alias("item_price"), F.coalesce(F.col("sale_status").cast("int"), F.lit(0)).alias("sale_status"),
    )
    kept = read.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min(F.struct("sale_status", "item_price", "category", "brand")).alias("r"))
    return kept.select("item_id", "r.category", "r.brand", "r.item_price", "r.sale_status")


def purchase_engagement(events: DataFrame) -> DataFrame:
    """engagement from an event table; a location column is kept if there is one."""
    place = [V.valid_location(F.col("location")).alias("location")] if "location" in events.columns else []
    return events.select(*place, V.item_key(F.col("item_id")).alias("item_id"), F.col("event_date").cast("date").alias("event_date"), V.token(F.col("event_type")).alias("event_type"), F.col("quantity").cast("decimal(18,0)").alias("quantity")).dropna(subset=["item_id", "event_date"])
