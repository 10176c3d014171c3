"""Month cubes. A month is an absolute number, year*12 + month, so that years never mix."""

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.tables import settled


def month_number(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def month_start(number: int) -> datetime.date:
    return datetime.date((number - 1) // 12, (number - 1) % 12 + 1, 1)


def in_months(day: Column, first: int, last: int) -> Column:
    """A plain date range for months first to last, which the scan can use."""
    return (day >= F.lit(month_start(first))) & (day < F.lit(month_start(last + 1)))


def sales_months(sales: DataFrame, first: int, last: int) -> DataFrame:
    """location, item_id, m, qty (bigint), rev (decimal): partial sums are combined before the one shuffle."""
    kept = sales.where(in_months(F.col("sale_date"), first, last) & F.col("location").isNotNull() & F.col("item_id").isNotNull())
    return kept.groupBy("location", "item_id", month_number(F.col("sale_date")).alias("m")).agg(
        F.sum("quantity").cast("bigint").alias("qty"), F.sum(F.coalesce(F.col("quantity") * F.col("price"), F.lit(0))).alias("rev")
    )


def engagement_months(engagement: DataFrame, first: int, last: int, fold_years: bool = False, views: str = "view_item", carts: str = "add_to_cart") -> DataFrame:
    """([location,] item_id, m): rows and quantities of views and cart events. fold_years counts events of any
    year in the month of the last year of the range with the same name (kept for comparison only)."""
    keys = [c for c in ("location", "item_id") if c in engagement.columns]
    day = F.col("event_date")
    kept = engagement.where(F.col("event_type").isin(views, carts))
    if fold_years:
        m = (F.lit((last - 1) // 12 * 12) + F.month(day)).cast("int")
        kept = kept.withColumn("m", m).where(F.col("m").between(first, last))
    else:
        kept = kept.where(in_months(day, first, last)).withColumn("m", month_number(day))
    view, cart = F.col("event_type") == views, F.col("event_type") == carts
    zero = F.lit(0).cast("decimal(18,0)")
    return kept.groupBy(*keys, "m").agg(
        F.count_if(view).alias("view_count"), F.count_if(cart).alias("atc_count"),
        F.sum(F.when(view, F.col("quantity")).otherwise(zero)).cast("bigint").alias("view_qty"),
        F.sum(F.when(cart, F.col("quantity")).otherwise(zero)).cast("bigint").alias("atc_qty"),
    )


def grain_months(cube: DataFrame, key: str) -> DataFrame:
    """A cube of one key from the pair cube: qty, rev and active, the pairs with a positive quantity."""
    return cube.groupBy(key, "m").agg(F.sum("qty").alias("qty"), F.sum("rev").alias("rev"), F.count_if(F.col("qty") > 0).alias("active"))


def all_grains(cube: DataFrame, items: DataFrame) -> DataFrame:
    """Pair, item, location, category and brand months in one pass by grouping sets: grain, the keys, m, qty, rev."""
    wide = cube.join(items.select("item_id", "category", "brand"), "item_id", "left").fillna("__missing__", ["category", "brand"])
    sets = wide.groupingSets(
        [[F.col("location"), F.col("item_id"), F.col("m")], [F.col("item_id"), F.col("m")], [F.col("location"), F.col("m")], [F.col("category"), F.col("m")], [F.col("brand"), F.col("m")]],
        F.col("location"), F.col("item_id"), F.col("category"), F.col("brand"), F.col("m"),
    )
    out = sets.agg(F.sum("qty").alias("qty"), F.sum("rev").cast("double").alias("rev"), F.grouping_id().alias("g"))
    names = F.when(F.col("g") == 6, "pair").when(F.col("g") == 22, "item").when(F.col("g") == 14, "location").when(F.col("g") == 26, "category").otherwise("brand")
    return out.select(names.alias("grain"), "location", "item_id", "category", "brand", "m", "qty", "rev")


def dense_months(cube: DataFrame, keys: list[str], value: str, first: int, last: int) -> DataFrame:
    """One column per month, 0 where there is none: the dense matrix of an entity, in one aggregation."""
    return cube.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("m") == m, F.col(value))), F.lit(0)).alias(f"m{m - first + 1:02d}") for m in range(first, last + 1)))


def unit_prices(cube: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, price: the listed price, else the median unit price of pair months with a positive quantity, else 0."""
    sold = cube.where(F.col("qty") > 0).groupBy("item_id").agg(F.median(F.col("rev").cast("double") / F.col("qty")).alias("__median"))
    listed = items.select("item_id", F.col("item_price").cast("double").alias("__listed"))
    both = sold.join(listed, "item_id", "left")
    return both.select("item_id", F.when(F.col("__listed") > 0, F.col("__listed")).otherwise(F.coalesce("__median", F.lit(0.0))).alias("price"))


def grain_cubes(cube: DataFrame, keys: list[str]) -> DataFrame:
    """grain_months of several keys in one pass: the keys (all but a row's own are null), m, qty, rev, active. Keys aren't null."""
    m = F.col("m")
    sets = cube.groupingSets([[F.col(k), m] for k in keys], *(F.col(k) for k in keys), m)
    return sets.agg(F.sum("qty").alias("qty"), F.sum("rev").alias("rev"), F.count_if(F.col("qty") > 0).alias("active")).select(*keys, "m", "qty", "rev", "active")


def value_codes(values: DataFrame) -> DataFrame:
    """field, value, code: the place (from 0) of each distinct value of a field (columns field, value as text) in binary string
    order; nulls have none. Values are sorted in ranges of about equal size, however they are spelled, and a range's
    places start after all earlier ones, so no task sorts them all; the driver gets nothing."""
    spark = values.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = values.where(F.col("value").isNotNull()).select("field", "value").distinct().repartitionByRange(ranges, "field", "value").sortWithinPartitions("field", "value")
    placed = settled(ordered.select("field", "value", F.monotonically_increasing_id().alias("__id")))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    numbered = placed.withColumn("__part", part).join(sizes.select("__part", before.alias("__start")), "__part").select("field", "value", (F.col("__start") + place).alias("__at"))
    starts = numbered.groupBy("field").agg(F.min("__at").alias("__first"))  # a row per field
    return numbered.join(starts, "field").select("field", "value", (F.col("__at") - F.col("__first")).cast("int").alias("code"))


def dictionary_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """value_codes of one column, as column and code."""
    codes = value_codes(df.select(F.lit(column).alias("field"), F.col(column).cast("string").alias("value")))
    return codes.select(F.col("value").cast(df.schema[column].dataType).alias(column), F.col("code").alias(code))
