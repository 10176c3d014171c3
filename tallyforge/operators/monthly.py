"""Calendar-month series features for any number of target months in one pass."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.config import DEFAULTS, EngineConfig
from tallyforge.operators.cubes import grain_cubes, month_start, value_codes
from tallyforge.sources.tables import settled

BLOCKS = ("item", "location", "events", "category", "brand")
LAGS = (1, 2, 3, 4, 5, 6)


def for_targets(cube: DataFrame, targets: list[int], same_month: bool = False) -> DataFrame:
    """Each cube row once for every target month after it (and its own, if that is one and same_month is set), as column
    t. Targets are a short literal list."""
    ahead = F.filter(F.array(*(F.lit(t) for t in targets)), lambda t: t >= F.col("m") if same_month else t > F.col("m"))
    return cube.withColumn("t", F.explode(ahead))


Series = dict[str, tuple[str, bool]]


def series_base(cube: DataFrame, keys: list[str], series: Series, targets: list[int], more: tuple[str, ...] = ()) -> DataFrame:
    """The sums from which a block of features is made, one row per entity and target: the last six months of each
    series (prefix -> (value column, full)), and for a full one its last month with sales and their number. more has
    further aggregates, which see the target month's rows too.

    Months without a row are zeros (conditional sums, no spine). What is joined later are these few columns; all
    features come out of one projection at the end."""
    aggs = []
    for prefix, (value, full) in series.items():
        v = f"cast({value} as double)"
        aggs += [f"coalesce(sum(case when t - m = {k} then {v} end), 0D) as {prefix}__{k}" for k in LAGS]
        if full:
            aggs += [f"max(case when m < t and {v} > 0 then m end) as {prefix}__last", f"count_if(m < t and {v} > 0) as {prefix}__n"]
    return for_targets(cube, targets, bool(more)).groupBy(*keys, "t").agg(*map(F.expr, [*aggs, *more]))


def lag(prefix: str, k: int) -> str:
    return f"coalesce({prefix}__{k}, 0D)"


def over(a: str, b: str) -> str:
    """a / (b + 1); 0 where b is -1, as after returns."""
    return f"coalesce(try_divide({a}, {b} + 1), 0D)"


def mean3(prefix: str) -> str:
    return f"(({lag(prefix, 3)} + {lag(prefix, 2)} + {lag(prefix, 1)}) / 3)"


def series_columns(series: Series, start: int) -> dict[str, str]:
    """The features of each series over its sums. The short block has lags 1, 2, 3, 6 and means of 3 and 6 months;
    the full one adds median, population deviation, maximum and minimum of 3 months, recency, counts, trend and
    growth. The history is the months from start to t-1; an entity without sums has zeros."""
    out: dict[str, str] = {}
    for p, (_, full) in series.items():
        a, b, c = (lag(p, k) for k in (1, 2, 3))
        m = mean3(p)
        out |= {f"{p}_lag{k}": lag(p, k) for k in (1, 2, 3, 6)}
        out |= {f"{p}_roll_mean_3": m, f"{p}_roll_mean_6": f"({lag(p, 6)} + {lag(p, 5)} + {lag(p, 4)} + {c} + {b} + {a}) / 6"}
        if full:
            months, n = f"cast(t - {start} as bigint)", f"coalesce({p}__n, 0L)"
            out |= {
                f"{p}_roll_median_3": f"greatest(least({a}, {b}), least(greatest({a}, {b}), {c}))",
                f"{p}_roll_std_3": "sqrt((" + " + ".join(f"({x} - {m}) * ({x} - {m})" for x in (a, b, c)) + ") / 3)",
                f"{p}_roll_max_3": f"greatest({a}, {b}, {c})", f"{p}_roll_min_3": f"least({a}, {b}, {c})",
                f"{p}_months_since_last_sale": f"coalesce(cast(t - 1 - {p}__last as bigint), {months})",
                f"{p}_number_of_sale_months": n, f"{p}_zero_sale_months": f"{months} - {n}", f"{p}_trend_3": f"{a} - {c}",
                f"{p}_growth_ratio": over(a, b), f"{p}_lag1_to_roll3": over(a, m),
            }
    return out


def series_features(cube: DataFrame, keys: list[str], series: Series, targets: list[int], start: int) -> DataFrame:
    """One row per entity and target month with the features of its series."""
    base = series_base(cube, keys, series, targets)
    return base.selectExpr(*keys, "t", *(f"{e} as {n}" for n, e in series_columns(series, start).items()))


def weighted_recent(prefix: str) -> str:
    return f"({lag(prefix, 1)} * 0.5D + {lag(prefix, 2)} * 0.3D + {lag(prefix, 3)} * 0.2D)"


def weighted_baseline() -> str:
    """Recent sales of the pair, or where there are none 0.7 of the item's per active location plus 0.3 of the
    location's per active item."""
    item = f"{weighted_recent('item_qty')} / greatest({weighted_recent('item_active_locs')}, 1D)"
    place = f"{weighted_recent('loc_qty')} / greatest({weighted_recent('loc_active_items')}, 1D)"
    pair = weighted_recent("li_qty")
    return f"greatest(case when {pair} > 0 then {pair} else {item} * 0.7D + {place} * 0.3D end, 0D)"


def pair_event_columns() -> dict[str, str]:
    """Ratios of the pair's own views and cart events, where events have a location."""
    view, cart, sold = mean3("li_view"), mean3("li_atc"), mean3("li_qty")
    return {"li_atc_per_view": over(cart, view), "li_purchase_per_view": over(sold, view), "li_purchase_per_atc": over(sold, cart)}


def conversion_columns() -> dict[str, str]:
    view, cart, sold = "view_item", "add_to_cart", "item_qty"
    return {
        "atc_to_view_lag1": over(lag(cart, 1), lag(view, 1)), "purchase_to_atc_lag1": over(lag(sold, 1), lag(cart, 1)),
        "atc_to_view_roll3": over(mean3(cart), mean3(view)), "purchase_to_atc_roll3": over(mean3(sold), mean3(cart)),
    }


def event_columns() -> dict[str, str]:
    """The optional event block: aliases and ratios of the views and cart events of the item."""
    view, cart, sold, out = mean3("view_item"), mean3("add_to_cart"), mean3("item_qty"), {}
    for k in (1, 2, 3):
        out |= {f"item_view_lag{k}": lag("view_item", k), f"item_atc_lag{k}": lag("add_to_cart", k)}
    ratios = {"atc_per_view": over(cart, view), "purchase_per_view": over(sold, view), "purchase_per_atc": over(sold, cart)}
    return out | {"item_view_roll3": view, "item_atc_roll3": cart} | {f"item_{n}": r for n, r in ratios.items()} | ratios


def new_year_rows(targets: list[int], config: EngineConfig = DEFAULTS) -> list[tuple]:
    """(t, days to the next lunar new year, overlaps with 60, 45, 30 days before, its month, 30 days after) per target: plan constants."""
    import datetime

    rows = []
    for t in targets:
        first, last = month_start(t), month_start(t + 1) - datetime.timedelta(days=1)
        ahead = [d for d in sorted(config.new_years) if d >= first]
        day = ahead[0] if ahead else datetime.date(max(config.new_years).year + 1, 2, 1)
        meets = lambda a, b: int(first <= day + datetime.timedelta(days=b) and last >= day + datetime.timedelta(days=a))  # noqa: B023, E731
        rows.append((t, float((day - first).days), meets(-60, -1), meets(-45, -1), meets(-30, -1), int((first.year, first.month) == (day.year, day.month)), meets(0, 30)))
    return rows


def new_year_columns() -> dict[str, str]:
    """The eleven columns of the lunar new year over the joined constants and category_code."""
    out = {n: n for n in ("days_to_tet", "is_pre_tet_60d", "is_pre_tet_45d", "is_pre_tet_30d", "is_tet_month", "is_post_tet_30d")}
    out |= {"weeks_to_tet": "days_to_tet / 7D", "abs_days_to_tet": "abs(days_to_tet)"}
    return out | {f"category_pre_tet_{n}d_code": f"case when is_pre_tet_{n}d = 1 then category_code + 1 else 0 end" for n in (60, 45, 30)}


def with_status(cube: DataFrame, items: DataFrame) -> DataFrame:
    """Cube rows of items that are listed as sold or not listed at all; status 0 is dropped. Adds category, brand."""
    meta = items.select("item_id", "category", "brand", F.coalesce(F.col("sale_status"), F.lit(0)).alias("sale_status"))
    known = cube.join(meta, "item_id", "left").where(F.coalesce(F.col("sale_status"), F.lit(1)) != 0)
    return known.drop("sale_status").fillna("__missing__", ["category", "brand"])


def monthly_frame(cube: DataFrame, events: DataFrame, items: DataFrame, targets: list[int], start: int, label: bool = True, config: EngineConfig = DEFAULTS, codes: bool = True, blocks: tuple[str, ...] = BLOCKS) -> DataFrame:
    """The feature table of all targets: a row for each pair with sales before the target and target month t.

    cube is the pair cube from start to the last target, events the event cube of items, or of pairs: then config.event_features
    also gives the pair's own event block. The cube with its metadata is written once; pairs, series and labels are one
    aggregation of it, all other grains one pass of grouping sets, and a grain's codes come with its sums. What belongs to an item, its
    category or its brand is put together by item, so that the pairs meet it in one join, and their location in a second. blocks
    names those a consumer needs: an outer join is not pruned by itself when its columns are.
    """
    sold = settled(with_status(cube, items))
    full, short = True, False
    series: Series = {"li_qty": ("qty", full), "li_rev": ("rev", short)}
    more = ["sum(case when m < t then qty end) as __seen"]
    more += ["cast(sum(case when m = t then qty end) as double) as __y", "cast(sum(case when m = t then rev end) as double) as __r"] * label
    frame = series_base(sold, ["location", "item_id"], series, targets, tuple(more)).where("__seen > 0").drop("__seen")
    counts = events.groupBy("item_id", "m").agg(F.sum("view_count").alias("view_count"), F.sum("atc_count").alias("atc_count"))
    parts = {
        "item": (["item_id"], None, {"item_qty": ("qty", full), "item_rev": ("rev", short), "item_active_locs": ("active", short)}),
        "location": (["location"], None, {"loc_qty": ("qty", full), "loc_rev": ("rev", short), "loc_active_items": ("active", short)}),
        "events": (["item_id"], counts, {"view_item": ("view_count", short), "add_to_cart": ("atc_count", short)}),
        "category": (["category"], None, {"cat_qty": ("qty", full)}),
        "brand": (["brand"], None, {"brand_qty": ("qty", full)}),
        "pair_events": (["location", "item_id"], events, {"li_view": ("view_count", short), "li_atc": ("atc_count", short)}),
    }
    if config.event_features and "events" in blocks and "location" in events.columns:
        blocks = (*blocks, "pair_events")
    named = {"location": "location_code", "item_id": "item_code", "category": "category_code", "brand": "brand_code"} if codes else {}
    grains = [k for k, block in (("item_id", "item"), ("location", "location"), ("category", "category"), ("brand", "brand")) if block in blocks or codes]
    wide = settled(grain_cubes(sold, grains)) if grains else sold
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value")) for k in grains)))
    coded = value_codes(wide.select(each.alias("x")).select("x.*")) if codes else None
    columns = {c: c for c in ("location", "item_id", "category", "brand", "t")} | {"target_month_idx": f"t - {start} + 1"}
    code_of = {k: coded.where(F.col("field") == k).select(F.col("value").cast(wide.schema[k].dataType).alias(k), F.col("code").alias(n)) for k, n in named.items()}
    born = sold.groupBy("item_id", "category", "brand").agg(F.min("m").alias("m"))
    by_item = for_targets(born, targets).select("item_id", "category", "brand", "t")
    by_place = None
    for block in blocks:
        keys, source, own = parts[block]
        base = series_base(wide.where(F.col(keys[0]).isNotNull()) if source is None else source, keys, own, targets)
        series = series | own
        if block == "location":
            by_place = base
        elif block == "pair_events":
            frame = frame.join(base, [*keys, "t"], "left")
        else:
            by_item = by_item.join(base, [*keys, "t"], "left")
    for key in ("item_id", "category", "brand"):
        if key in code_of:
            by_item = by_item.join(code_of[key], key)
    frame = frame.join(by_item, ["item_id", "t"])
    if by_place is not None:
        frame = frame.join(by_place, ["location", "t"], "left")
    if "location" in code_of:
        frame = frame.join(code_of["location"], "location")
    columns |= {n: n for n in named.values()}
    turn = f"((t - 1) % 12 + 1) * {2 * math.pi / 12!r}D"
    columns |= {"month_sin": f"sin({turn})", "month_cos": f"cos({turn})"} | series_columns(series, start)
    if {"item", "events"} <= {*blocks}:
        columns |= conversion_columns() | (event_columns() if config.event_features else {})
    if "pair_events" in blocks:
        columns |= pair_event_columns()
    if config.calendar_features:
        small = frame.sparkSession.createDataFrame(new_year_rows(targets, config), "t int, days_to_tet double, is_pre_tet_60d int, is_pre_tet_45d int, is_pre_tet_30d int, is_tet_month int, is_post_tet_30d int")
        frame = frame.join(F.broadcast(small), "t")  # a row per target
        columns |= new_year_columns()
    columns |= {"baseline_lag1": lag("li_qty", 1), "baseline_rolling3": mean3("li_qty")}
    if {"item", "location"} <= {*blocks}:
        columns["baseline_weighted"] = weighted_baseline()
    if label:
        columns |= {"target": "coalesce(__y, 0D)", "target_revenue": "coalesce(__r, 0D)"}
    return frame.selectExpr(*(f"{e} as `{n}`" for n, e in columns.items()))
