"""Trailing day windows at a cutoff: all windows of a grain in one pass over day totals."""

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import DEFAULTS, EngineConfig
from tallyforge.sources.tables import settled

PAIR = ["location", "item_id"]


def in_window(day: Column, cutoff: datetime.date, days: int) -> Column:
    """cutoff-days < day <= cutoff: a range over the plain column, which the scan can use."""
    return (day > F.lit(cutoff - datetime.timedelta(days=days))) & (day <= F.lit(cutoff))


def day_totals(sales: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and day: quantity q, revenue r (a null price adds nothing) and p, the highest positive price."""
    priced = F.when(F.col("price") > 0, F.col("price"))
    return sales.groupBy(*keys, "sale_date").agg(F.sum("quantity").cast("bigint").alias("q"), F.sum(F.coalesce(F.col("quantity") * F.col("price"), F.lit(0))).alias("r"), F.max(priced).alias("p"))


def last_positive_price(sales: DataFrame, keys: list[str]) -> DataFrame:
    """The price of the latest sale with a positive price; of several on that day the highest."""
    priced = sales.where(F.col("price") > 0)
    return priced.groupBy(*keys).agg(F.max(F.struct("sale_date", "price")).alias("x")).select(*keys, F.col("x.price").cast("double").alias("last_price"))


def pair_windows(totals: DataFrame, keys: list[str], cutoff: datetime.date, config: EngineConfig = DEFAULTS, target: datetime.date | None = None) -> DataFrame:
    """All that a cutoff's features take from the fact table, one row per key with a row by the cutoff, in one aggregation
    of day totals: the columns of trailing(), sums and revenues of further windows, __rows_Nd (days with rows in
    the last N), last_price and, for a target, the label of its month. Columns nobody takes are pruned."""
    q, r, day = F.col("q"), F.col("r"), F.col("sale_date")
    past = day <= F.lit(cutoff)
    aggs = [F.count(F.when(past, F.lit(1))).alias("__seen")]
    for n in sorted({*config.sum_days, *config.std_days, *config.price_days, *config.entity_days, *config.revenue_days}):
        w = in_window(day, cutoff, n)
        aggs += [F.sum(F.when(w, q)).alias(f"sales_sum_{n}d"), F.sum(F.when(w, r)).cast("double").alias(f"revenue_sum_{n}d"), F.count(F.when(w, F.lit(1))).alias(f"__rows_{n}d")]
        if n in config.std_days:
            aggs += [F.count(F.when(w, q)).alias(f"__n{n}"), F.sum(F.when(w, q * q)).cast("double").alias(f"__s{n}")]
        if n in config.active_days:
            aggs.append(F.sum(F.when(w, (q > 0).cast("bigint"))).alias(f"sales_nonzero_days_{n}d"))
    aggs.append(F.datediff(F.lit(cutoff), F.max(F.when(past & (q > 0), day))).cast("bigint").alias("days_since_last_sale"))
    aggs.append(F.max(F.when(past & F.col("p").isNotNull(), F.struct("sale_date", "p"))).alias("__last"))
    if target:
        first, following = month_bounds(target)
        inside = (day >= F.lit(first)) & (day < F.lit(following))
        aggs += [F.sum(F.when(inside, q)).alias("sales_next_month"), F.sum(F.when(inside, r)).cast("double").alias("revenue_next_month")]
    out = totals.groupBy(*keys).agg(*aggs).where(F.col("__seen") > 0)
    cols = {c: F.col(c) for c in out.columns if c not in keys and not c.startswith(("__n", "__s", "__last"))}
    mean = {n: F.col(f"sales_sum_{n}d").cast("double") / n for n in config.sum_days}
    cols |= {f"sales_mean_{n}d": m for n, m in mean.items()}
    for n in config.std_days:
        k, s = F.col(f"__n{n}"), F.col(f"sales_sum_{n}d").cast("double")
        cols[f"sales_std_{n}d"] = F.when(k > 1, F.sqrt(F.greatest((F.col(f"__s{n}") - s * s / k) / (k - 1), F.lit(0.0))))
    eps = F.lit(config.epsilon)
    cols["trend_7_vs_28"], cols["trend_28_vs_90"] = mean[7] / (mean[28] + eps), mean[28] / (mean[90] + eps)
    price = {n: F.col(f"revenue_sum_{n}d") / (F.col(f"sales_sum_{n}d").cast("double") + eps) for n in config.price_days}
    cols |= {f"avg_price_{n}d": p for n, p in price.items()}
    cols["price_change_28_vs_90"] = price[28] / (price[90] + eps)
    cols["last_price"] = F.col("__last.p").cast("double")
    return out.select(*keys, *(c.alias(n) for n, c in cols.items()))


def trailing_columns(config: EngineConfig = DEFAULTS) -> list[str]:
    """The pair features in their order."""
    names = [f"{kind}_{n}d" for kind, days in (("sales_sum", config.sum_days), ("sales_mean", config.sum_days), ("sales_std", config.std_days), ("sales_nonzero_days", config.active_days)) for n in days]
    names += ["days_since_last_sale", "trend_7_vs_28", "trend_28_vs_90", *(f"revenue_sum_{n}d" for n in config.revenue_days), *(f"avg_price_{n}d" for n in config.price_days)]
    return [*names, "price_change_28_vs_90"]


def trailing(totals: DataFrame, keys: list[str], cutoff: datetime.date, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Pair features at a cutoff: sums, means by calendar days, sample deviation of day totals, days with sales,
    recency, trends, revenue and average prices. Null where a window has no rows; rows after the cutoff have no part."""
    return pair_windows(totals, keys, cutoff, config).select(*keys, *trailing_columns(config))


def entity_sums(pairs: DataFrame, key: str, prefix: str, count_name: str, trend: str, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Sums of one key over its pairs (rows of pair_windows), the number of pairs with rows in a window, and the 28 to 90 day
    ratio. A hot key is one row per pair, combined before the shuffle; a window without rows has no count."""
    rows = lambda n: F.col(f"__rows_{n}d") > 0
    out = pairs.where(rows(max(config.entity_days))).groupBy(key).agg(
        *(F.sum(f"sales_sum_{n}d").alias(f"{prefix}_sales_sum_{n}d") for n in config.entity_days),
        *(F.nullif(F.count_if(rows(n)), F.lit(0)).alias(f"{count_name}_{n}d") for n in config.price_days),
    )
    ratio = F.col(f"{prefix}_sales_sum_28d").cast("double") / (F.col(f"{prefix}_sales_sum_90d").cast("double") + config.epsilon)
    return out.withColumn(trend, ratio)


def entity_windows(totals: DataFrame, key: str, other: str, cutoff: datetime.date, prefix: str, count_name: str, trend: str, config: EngineConfig = DEFAULTS) -> DataFrame:
    """entity_sums from day totals of the pairs of key and other."""
    return entity_sums(pair_windows(totals, [key, other], cutoff, config), key, prefix, count_name, trend, config)


def category_sums(pairs: DataFrame, items: DataFrame, days: int = 28, epsilon: float = 1e-6) -> DataFrame:
    """item_id, category, category_sales_sum_28d and item_share_in_category of items sold in the window, from rows of
    pair_windows. Items without a category are left out."""
    sold = pairs.where(F.col(f"__rows_{days}d") > 0).groupBy("item_id").agg(F.sum(f"sales_sum_{days}d").alias("__q"))
    known = sold.join(items.select("item_id", "category"), "item_id").where(F.col("category").isNotNull())
    per = known.groupBy("category").agg(F.sum("__q").alias(f"category_sales_sum_{days}d"))
    share = F.col("__q").cast("double") / (F.col(f"category_sales_sum_{days}d").cast("double") + epsilon)
    return known.join(per, "category").select("item_id", "category", f"category_sales_sum_{days}d", share.alias("item_share_in_category"))


def category_windows(totals: DataFrame, items: DataFrame, cutoff: datetime.date, days: int = 28, epsilon: float = 1e-6) -> DataFrame:
    """category_sums from day totals of pairs."""
    return category_sums(pair_windows(totals, PAIR, cutoff), items, days, epsilon)


def engagement_windows(engagement: DataFrame, cutoff: datetime.date, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Quantity of views and cart events per item over trailing days."""
    aggs = []
    for n in config.engagement_days:
        for kind, name in ((config.view_event, "view"), (config.cart_event, "atc")):
            hit = in_window(F.col("event_date"), cutoff, n) & (F.col("event_type") == kind)
            aggs.append(F.sum(F.when(hit, F.col("quantity"))).cast("bigint").alias(f"{name}_count_{n}d"))
    kept = engagement.where(in_window(F.col("event_date"), cutoff, max(config.engagement_days)))
    return kept.groupBy("item_id").agg(*aggs)


def engagement_ratios(df: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """Adds the five conversion ratios to a frame with sales_sum_28d and the engagement windows."""
    d = {c: F.col(c).cast("double") for c in ("sales_sum_28d", "atc_count_28d", "view_count_28d", "view_count_7d", "atc_count_7d")}
    ratio = lambda a, b: d[a] / (d[b] + epsilon)
    return df.withColumns({
        "view_to_atc_rate_28d": ratio("atc_count_28d", "view_count_28d"), "atc_to_purchase_rate_28d": ratio("sales_sum_28d", "atc_count_28d"),
        "view_to_purchase_rate_28d": ratio("sales_sum_28d", "view_count_28d"), "recent_view_ratio": ratio("view_count_7d", "view_count_28d"),
        "recent_atc_ratio": ratio("atc_count_7d", "atc_count_28d"),
    })


def calendar_columns(cutoff: datetime.date, target: datetime.date | None = None) -> dict[str, Column]:
    """Constants of the target month, by default the month after the cutoff; target is any day of it."""
    first, following = month_bounds(target or month_bounds(cutoff)[1])
    return {
        "cutoff_month": F.lit(cutoff.month), "target_month": F.lit(first.month), "days_in_target_month": F.lit((following - first).days),
        "is_january_target": F.lit(int(first.month == 1)), "quarter": F.lit((first.month - 1) // 3 + 1),
    }


def month_bounds(day: datetime.date) -> tuple[datetime.date, datetime.date]:
    """The first days of the day's month and of the next."""
    first = day.replace(day=1)
    return first, (first.replace(day=28) + datetime.timedelta(days=4)).replace(day=1)


def month_label(sales: DataFrame, year: int, month: int, keys: list[str]) -> DataFrame:
    """Sales and revenue of the keys in one month, as sales_next_month and revenue_next_month."""
    low, high = month_bounds(datetime.date(year, month, 1))
    kept = sales.where((F.col("sale_date") >= F.lit(low)) & (F.col("sale_date") < F.lit(high)))
    revenue = F.sum(F.coalesce(F.col("quantity") * F.col("price"), F.lit(0))).cast("double")
    return kept.groupBy(*keys).agg(F.sum("quantity").cast("bigint").alias("sales_next_month"), revenue.alias("revenue_next_month"))


def classic_frame(sales: DataFrame, items: DataFrame, engagement: DataFrame, cutoff: datetime.date, target: datetime.date | None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """The whole feature table at a cutoff: pairs with a sale by then, all groups of features, status, and the
    target month's label (none without target). Numbers that are null become 0 at the end, after all ratios.

    The fact table is read once: its pair windows are written to the shared folder, and all other grains come from there."""
    day = F.col("sale_date")
    wanted = day <= F.lit(cutoff)
    if target:
        first, following = month_bounds(target)
        wanted = wanted | ((day >= F.lit(first)) & (day < F.lit(following)))
    pairs = settled(pair_windows(day_totals(sales.where(wanted), PAIR), PAIR, cutoff, config, target))
    label = ["sales_next_month", "revenue_next_month"] if target else []
    frame = pairs.select(*PAIR, *trailing_columns(config), "last_price", *label)
    per = category_sums(pairs, items, epsilon=config.epsilon)
    by_item = items.select("item_id", "category", F.col("sale_status").cast("bigint").alias("sale_status"))
    sold = entity_sums(pairs, "item_id", "item", "item_num_locations_sold", "item_global_trend_28_vs_90", config)
    shares = per.select("item_id", "item_share_in_category")
    # what belongs to an item is joined with items, not with pairs, which meet it once
    of_item = pairs.select("item_id").distinct().join(by_item, "item_id", "left").join(sold, "item_id", "left").join(shares, "item_id", "left").join(engagement_windows(engagement, cutoff, config), "item_id", "left")
    of_item = of_item.join(per.select("category", "category_sales_sum_28d").distinct(), "category", "left")
    frame = frame.join(of_item, "item_id")
    frame = frame.join(entity_sums(pairs, "location", "location", "location_active_items", "location_sales_trend_28_vs_90", config), "location", "left")
    frame = engagement_ratios(frame, config.epsilon).withColumns(calendar_columns(cutoff, target))
    numeric = [c for c, k in frame.dtypes if k in ("bigint", "int", "double") and c not in PAIR]
    return frame.fillna(0, numeric)
