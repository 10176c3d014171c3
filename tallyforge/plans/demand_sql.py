"""The demand queries in SQL, for an independent engine over the same tables: star schema, and purchase tables (*_2025)."""

import re

from tallyforge.plans.value_sql import item_sql, price_sql, type_sql

CUT = "date '1998-11-30'"
START, TARGET = 1998 * 12 + 1, 1998 * 12 + 12
#: The last whole month by the cutoff.
LAST_MONTH = "sale_date >= date '1998-11-01' and sale_date < date '1998-12-01'"

VIEWS = """
sales as (select cast(n_regionkey as int) as location, cast(l_partkey as varchar) as item_id, cast(l_shipdate as date) as sale_date,
 cast(l_quantity as decimal(18,0)) as quantity, cast(l_extendedprice as decimal(18,2)) as price
 from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
items as (select cast(p_partkey as varchar) as item_id, p_type as category, p_brand as brand, cast(p_retailprice as decimal(18,2)) as item_price,
 case when p_size > 40 then 0 else 1 end as sale_status from part),
engagement as (select cast(user_id as varchar) as item_id, cast(cast(ts as date) - interval '9192' day as date) as event_date,
 case event_type when 'view' then 'view_item' else 'add_to_cart' end as event_type, 1 as quantity from events where event_type in ('view', 'click'))"""


def inside(days: int, c: str = "sale_date") -> str:
    return f"({c} > {CUT} - {days} and {c} <= {CUT})"


def sums(n: int) -> str:
    w = inside(n)
    return f"cast(sum(q) filter (where {w}) as bigint) as s{n}, cast(sum(r) filter (where {w}) as double) as v{n}, count(q) filter (where {w}) as k{n}, cast(sum(q*q) filter (where {w}) as double) as ss{n}, count(*) filter (where {w} and q > 0) as a{n}, count(*) filter (where {w}) as c{n}"


DAYS = (7, 14, 28, 56, 90)
PAIRS = f"""{VIEWS},
past as (select * from sales where sale_date <= {CUT}),
dt as (select location, item_id, sale_date, cast(sum(quantity) as bigint) as q, sum(coalesce(quantity * price, 0)) as r from past group by 1, 2, 3),
pw as (select location, item_id, {", ".join(map(sums, DAYS))}, date_diff('day', max(case when q > 0 then sale_date end), {CUT}) as since from dt group by 1, 2)"""


def std(n: int) -> str:
    return f"case when k{n} > 1 then round(sqrt(greatest((ss{n} - cast(s{n} as double) * s{n} / k{n}) / (k{n} - 1), 0)), 6) end as sales_std_{n}d"


def mean(n: int) -> str:
    return f"(cast(s{n} as double) / {n})"


def nonzero(n: int) -> str:
    return f"case when k{n} > 0 then a{n} end as sales_nonzero_days_{n}d"


def price(n: int) -> str:
    return f"(v{n} / (cast(s{n} as double) + 1e-6))"


CLASSIC = {
    "sums": ", ".join([f"s{n} as sales_sum_{n}d" for n in DAYS] + [f"v{n} as revenue_sum_{n}d" for n in (7, 28, 90)]),
    "means": ", ".join(f"{mean(n)} as sales_mean_{n}d" for n in DAYS),
    "std": ", ".join(map(std, (28, 56))),
    "active": ", ".join(map(nonzero, (28, 56, 90))),
    "since": "since as days_since_last_sale",
    "price": f"round({price(28)}, 6) as avg_price_28d, round({price(90)}, 6) as avg_price_90d, round({price(28)} / ({price(90)} + 1e-6), 6) as price_change_28_vs_90",
    "trend": f"round({mean(7)} / ({mean(28)} + 1e-6), 6) as trend_7_vs_28, round({mean(28)} / ({mean(90)} + 1e-6), 6) as trend_28_vs_90",
}


def entity(key: str, other: str, prefix: str, count: str, trend: str) -> str:
    s = ", ".join(f"cast(sum(q) filter (where {inside(n)}) as bigint) as {prefix}_sales_sum_{n}d" for n in (7, 28, 90))
    c = ", ".join(f"nullif(count(distinct {other}) filter (where {inside(n)}), 0) as {count}_{n}d" for n in (28, 90))
    return f"select *, round(cast({prefix}_sales_sum_28d as double) / (cast({prefix}_sales_sum_90d as double) + 1e-6), 6) as {trend} from (select {key}, {s}, {c} from dt where {inside(90)} group by 1)"


ITEM = entity("item_id", "location", "item", "item_num_locations_sold", "item_global_trend_28_vs_90")
PLACE = entity("location", "item_id", "location", "location_active_items", "location_sales_trend_28_vs_90")
CATEGORY = f"""select item_id, category, category_sales_sum_28d, round(cast(q as double) / (cast(category_sales_sum_28d as double) + 1e-6), 6) as item_share_in_category
from (select item_id, category, q, cast(sum(q) over (partition by category) as bigint) as category_sales_sum_28d
      from (select item_id, category, cast(sum(q) as bigint) as q from dt join items using (item_id) where {inside(28)} group by 1, 2))"""
ENGAGED = "select item_id, " + ", ".join(
    f"cast(sum(quantity) filter (where {inside(n, 'event_date')} and event_type = '{e}') as bigint) as {p}_count_{n}d" for n in (1, 3, 7, 14, 28) for e, p in (("view_item", "view"), ("add_to_cart", "atc"))
) + f" from engagement where {inside(28, 'event_date')} group by 1"


def ratio(name: str, a: str, b: str) -> str:
    return f"round(cast({a} as double) / (cast({b} as double) + 1e-6), 6) as {name}"


RATES = ", ".join([
    ratio("view_to_atc_rate_28d", "atc_count_28d", "view_count_28d"), ratio("atc_to_purchase_rate_28d", "s28", "atc_count_28d"), ratio("view_to_purchase_rate_28d", "s28", "view_count_28d"),
    ratio("recent_view_ratio", "view_count_7d", "view_count_28d"), ratio("recent_atc_ratio", "atc_count_7d", "atc_count_28d"),
])
LAST_PRICE = "select location, item_id, cast(max(price) as double) as last_price from (select *, rank() over (partition by location, item_id order by sale_date desc) as k from past where price > 0) where k = 1 group by 1, 2"
CALENDAR = "11 as cutoff_month, 12 as target_month, 31 as days_in_target_month, 0 as is_january_target, 4 as quarter"
LABEL = "select location, item_id, cast(sum(quantity) as bigint) as sales_next_month, cast(sum(coalesce(quantity * price, 0)) as double) as revenue_next_month from sales where year(sale_date) = 1998 and month(sale_date) = 12 group by 1, 2"
CLASSIC_FRAME = f"""with {PAIRS}, it as ({ITEM}), pl as ({PLACE}), ca as ({CATEGORY}), en as ({ENGAGED}), lp as ({LAST_PRICE}), la as ({LABEL}),
cs as (select distinct category, category_sales_sum_28d from ca),
base as (select pw.location, pw.item_id, s28, {", ".join((CLASSIC | {"means": ", ".join(f"round({mean(n)}, 6) as sales_mean_{n}d" for n in DAYS)}).values())} from pw),
j as (select * from base left join lp using (location, item_id) left join it using (item_id) left join pl using (location)
 left join (select item_id, category, cast(sale_status as bigint) as sale_status from items) using (item_id) left join cs using (category)
 left join (select item_id, item_share_in_category from ca) using (item_id) left join en using (item_id) left join la using (location, item_id)),
k as (select *, {RATES}, {CALENDAR} from j)
select location, item_id, category, coalesce(columns(* exclude (location, item_id, category, s28)), 0) from k"""

BASELINE = f"""{PAIRS},
bs as (select location, item_id, cast(sum(quantity) filter (where {LAST_MONTH}) as double) as last, {", ".join(f"cast(sum(quantity) filter (where {inside(n)}) as double) * 31 / {n} as r{n}" for n in (28, 56, 90))} from past group by 1, 2),
av as (select item_id, cast(sum(quantity) as double) / count(quantity) as item_global_avg from past where {inside(90)} group by 1),
bl as (select location, item_id, case when coalesce(last, r90, r56, r28) is null then greatest(coalesce(item_global_avg, 0), 0)
 else coalesce({", ".join(f"case when {c} >= 0 then {c} end" for c in ("last", "r90", "r56", "r28"))}, 0) end as prediction from bs left join av using (item_id))"""
TRUTH = f"tr as (select location, item_id, cast(sales_next_month as double) as sales, revenue_next_month as revenue from ({LABEL}) where sales_next_month > 0)"
EVALUATED = f"""{BASELINE}, {TRUTH}, up as (select item_id, avg(revenue / sales) as price from tr group by 1),
ev as (select sales as y, revenue as r, coalesce(prediction, 0) as p, coalesce(prediction, 0) * price as e from tr left join bl using (location, item_id) left join up using (item_id))"""

CUBE = f"""{VIEWS},
cube0 as (select location, item_id, cast(year(sale_date) * 12 + month(sale_date) as int) as m, cast(sum(quantity) as bigint) as qty, sum(coalesce(quantity * price, 0)) as rev
 from sales where sale_date >= date '1998-01-01' and sale_date < date '1999-02-01' group by 1, 2, 3),
cube as (select * from cube0 where m <= {TARGET}),
evm as (select item_id, cast(year(event_date) * 12 + month(event_date) as int) as m, count(*) filter (where event_type = 'view_item') as view_count, count(*) filter (where event_type = 'add_to_cart') as atc_count,
 cast(sum(case when event_type = 'view_item' then quantity else 0 end) as bigint) as view_qty, cast(sum(case when event_type = 'add_to_cart' then quantity else 0 end) as bigint) as atc_qty from engagement
 where event_type in ('view_item', 'add_to_cart') and event_date >= date '1998-01-01' and event_date < date '1999-01-01' group by 1, 2),
kept as (select c.*, coalesce(category, '__missing__') as category, coalesce(brand, '__missing__') as brand from cube c left join items i using (item_id) where coalesce(sale_status, 1) <> 0)"""


def over(a: str, b: str) -> str:
    """a / (b + 1), 0 where that has no value."""
    return f"(case when {b} + 1 = 0 then 0 else {a} / ({b} + 1) end)"


def series(source: str, keys: str, prefixes: list[tuple[str, str, bool]], targets: list[int]) -> str:
    """The block of each (prefix, value, full), one row per key and target."""
    lags, last, out = [], [], []
    for p, v, full in prefixes:
        lags += [f"coalesce(sum(cast({v} as double)) filter (where t - m = {k}), 0) as {p}_{k}" for k in range(1, 7)]
        a = {k: f"{p}_{k}" for k in range(1, 7)}
        m3 = f"(({a[3]} + {a[2]} + {a[1]}) / 3)"
        out += [f"{a[k]} as {p}_lag{k}" for k in (1, 2, 3, 6)] + [f"{m3} as {p}_roll_mean_3", f"(({a[6]} + {a[5]} + {a[4]} + {a[3]} + {a[2]} + {a[1]}) / 6) as {p}_roll_mean_6"]
        if full:
            last += [f"max(m) filter (where {v} > 0) as {p}_last", f"count(*) filter (where {v} > 0) as {p}_n"]
            out += [
                f"list_sort([{a[1]}, {a[2]}, {a[3]}])[2] as {p}_roll_median_3",
                f"sqrt((({a[1]} - {m3}) * ({a[1]} - {m3}) + ({a[2]} - {m3}) * ({a[2]} - {m3}) + ({a[3]} - {m3}) * ({a[3]} - {m3})) / 3) as {p}_roll_std_3",
                f"greatest({a[1]}, {a[2]}, {a[3]}) as {p}_roll_max_3", f"least({a[1]}, {a[2]}, {a[3]}) as {p}_roll_min_3",
                f"cast(coalesce(t - 1 - {p}_last, t - {START}) as bigint) as {p}_months_since_last_sale", f"{p}_n as {p}_number_of_sale_months",
                f"cast(t - {START} - {p}_n as bigint) as {p}_zero_sale_months", f"{a[1]} - {a[3]} as {p}_trend_3", f"{over(a[1], a[2])} as {p}_growth_ratio", f"{over(a[1], m3)} as {p}_lag1_to_roll3",
            ]
    values = ", ".join(f"({t})" for t in targets)
    return f"select {keys}, t, {', '.join(out)} from (select {keys}, t, {', '.join(lags + last)} from {source}, (values {values}) as tt(t) where m < t group by {keys}, t)"


def recent(p: str) -> str:
    return f"({p}_lag1 * 0.5::double + {p}_lag2 * 0.3::double + {p}_lag3 * 0.2::double)"


CONVERSION = f"{over('add_to_cart_lag1', 'view_item_lag1')} as atc_to_view_lag1, {over('item_qty_lag1', 'add_to_cart_lag1')} as purchase_to_atc_lag1, {over('add_to_cart_roll_mean_3', 'view_item_roll_mean_3')} as atc_to_view_roll3, {over('item_qty_roll_mean_3', 'add_to_cart_roll_mean_3')} as purchase_to_atc_roll3"
WEIGHTED = f"greatest(case when {recent('li_qty')} > 0 then {recent('li_qty')} else {recent('item_qty')} / greatest({recent('item_active_locs')}, 1) * 0.7::double + {recent('loc_qty')} / greatest({recent('loc_active_items')}, 1) * 0.3::double end, 0)"


def frame(targets: list[int], source: str = "kept") -> str:
    last = max(targets)
    values = ", ".join(f"({t})" for t in targets)
    return f"""hist as (select * from {source} where m < {last}),
im as (select item_id, m, sum(qty) as qty, sum(rev) as rev, count(*) filter (where qty > 0) as active from hist group by 1, 2),
lm as (select location, m, sum(qty) as qty, sum(rev) as rev, count(*) filter (where qty > 0) as active from hist group by 1, 2),
cm as (select category, m, sum(qty) as qty from hist group by 1, 2), bm as (select brand, m, sum(qty) as qty from hist group by 1, 2),
ps as ({series("hist", "location, item_id", [("li_qty", "qty", True), ("li_rev", "rev", False)], targets)}),
si as ({series("im", "item_id", [("item_qty", "qty", True), ("item_rev", "rev", False), ("item_active_locs", "active", False)], targets)}),
sl as ({series("lm", "location", [("loc_qty", "qty", True), ("loc_rev", "rev", False), ("loc_active_items", "active", False)], targets)}),
sc as ({series("cm", "category", [("cat_qty", "qty", True)], targets)}), sb as ({series("bm", "brand", [("brand_qty", "qty", True)], targets)}),
se as ({series("evm", "item_id", [("view_item", "view_count", False), ("add_to_cart", "atc_count", False)], targets)}),
un as (select location, item_id, category, brand, t from hist, (values {values}) as tt(t) where m < t group by all having sum(qty) > 0),
fr0 as (select * replace ({", ".join(f"coalesce({p}_{x}, 0) as {p}_{x}" for p in ("view_item", "add_to_cart") for x in ("lag1", "lag2", "lag3", "lag6", "roll_mean_3", "roll_mean_6"))})
 from un join ps using (location, item_id, t) left join si using (item_id, t) left join sl using (location, t) left join se using (item_id, t) left join sc using (category, t) left join sb using (brand, t)),
fr as (select *, {CONVERSION}, li_qty_lag1 as baseline_lag1, li_qty_roll_mean_3 as baseline_rolling3, {WEIGHTED} as baseline_weighted,
 cast(t - {START} + 1 as int) as target_month_idx, sin(((t - 1) % 12 + 1) * (2 * pi() / 12)) as month_sin, cos(((t - 1) % 12 + 1) * (2 * pi() / 12)) as month_cos from fr0),
lb as (select location, item_id, m as t, cast(qty as double) as target, cast(rev as double) as target_revenue from {source}),
fl as (select fr.*, coalesce(target, 0) as target, coalesce(target_revenue, 0) as target_revenue from fr left join lb using (location, item_id, t))"""


FRAME = f"{CUBE}, {frame([TARGET])}"
MULTI = f"{CUBE}, {frame(list(range(START + 3, TARGET + 1)))}"
LABELS = "location, item_id, category, brand, t, target_month_idx"
ROUND = f"select {LABELS}, round(columns(* exclude ({LABELS})), 6)"
CODES = """cl as (select location, cast(dense_rank() over (order by cast(location as varchar)) - 1 as int) as location_code from (select distinct location from kept)),
ci as (select item_id, cast(dense_rank() over (order by item_id) - 1 as int) as item_code from (select distinct item_id from kept)),
cc as (select category, cast(dense_rank() over (order by category) - 1 as int) as category_code from (select distinct category from kept)),
cb as (select brand, cast(dense_rank() over (order by brand) - 1 as int) as brand_code from (select distinct brand from kept))"""
SCORED = f"""{FRAME},
yt as (select location, item_id, cast(sum(case when m = {TARGET} then qty else 0 end) as double) as y, cast(sum(case when m = {TARGET} then rev else 0 end) as double) as r from kept
 where location in (select location from kept where m = {TARGET} and qty > 0) group by 1, 2),
md as (select item_id, median(cast(rev as double) / qty) as md from kept where qty > 0 group by 1),
up as (select item_id, case when item_price > 0 then cast(item_price as double) else coalesce(md, 0) end as price from md left join items using (item_id)),
sr as (select location, item_id, y, r, greatest(coalesce(baseline_rolling3, 0), 0) as pred_raw, greatest(coalesce(baseline_lag1, 0), 0) as pred_log, greatest(coalesce(baseline_weighted, 0), 0) as pred_base,
 greatest(coalesce(li_qty_roll_mean_3, 0), 0) as recent, price from yt left join fr using (location, item_id) left join up using (item_id))"""


def mae(p: str, y: str = "y", digits: int = 4) -> str:
    return f"round(avg(abs({y} - {p})), {digits})"


def mape(p: str, y: str = "y", digits: int = 4) -> str:
    return f"round(avg(abs({y} - {p}) / greatest(abs({y}), 1e-6)) filter (where {y} > 0) * 100, {digits})"


CAPS = f"""{SCORED}, hm as (select * from kept where m <= {TARGET - 1}),
cpp as (select location, item_id, quantile_cont(qty, 0.99) as cap_pair from hm group by 1, 2),
cpi as (select item_id, quantile_cont(qty, 0.99) as cap_item, count(*) as n_item from hm group by 1),
cpl as (select location, quantile_cont(qty, 0.99) as cap_location, count(*) as n_location from hm group by 1),
cpg as (select quantile_cont(qty, 0.99) as cap_global from hm),
cr as (select * from sr left join cpp using (location, item_id) left join cpi using (item_id) left join cpl using (location))"""
KIND = "case k when 'pair' then cap_pair when 'item' then cap_item when 'location' then cap_location when 'min_item_location' then least(cap_item, cap_location) end"


def cut(kind: str, mult: str) -> str:
    cap = KIND.replace("case k", f"case {kind}")
    return f"(case when ({cap}) > 0 then least(pred_base, ({cap}) * {mult}) else pred_base end)"


def pairs(columns: str) -> str:
    return f"with {PAIRS} select location, item_id, {columns} from pw"


def pair_series(*columns: str) -> str:
    body = series(f"(select * from cube where m < {TARGET})", "location, item_id", [("li_qty", "qty", True)], [TARGET])
    cols = ", ".join(f"li_qty_{c}" if "months" in c else f"round(li_qty_{c}, 6) as li_qty_{c}" for c in columns)
    return f"with {CUBE}, s as ({body}) select location, item_id, {cols} from s"


def from_frame(columns: str) -> str:
    return f"with {FRAME} select location, item_id, {columns} from fr"


EVENT = "view_item_lag1 as item_view_lag1, view_item_lag2 as item_view_lag2, view_item_lag3 as item_view_lag3, add_to_cart_lag1 as item_atc_lag1, add_to_cart_lag2 as item_atc_lag2, add_to_cart_lag3 as item_atc_lag3, round(view_item_roll_mean_3, 6) as item_view_roll3, round(add_to_cart_roll_mean_3, 6) as item_atc_roll3, " + ", ".join(
    f"round({a} / ({b} + 1), 6) as {p}{n}" for n, a, b in (("atc_per_view", "add_to_cart_roll_mean_3", "view_item_roll_mean_3"), ("purchase_per_view", "item_qty_roll_mean_3", "view_item_roll_mean_3"), ("purchase_per_atc", "item_qty_roll_mean_3", "add_to_cart_roll_mean_3")) for p in ("", "item_")
)
YEAR = f"""with {CUBE}, kept2 as (select c.*, coalesce(category, '__missing__') as category, coalesce(brand, '__missing__') as brand from cube0 c left join items i using (item_id) where coalesce(sale_status, 1) <> 0),
cc as (select category, cast(dense_rank() over (order by category) - 1 as int) as category_code from (select distinct category from kept2)),
u as (select location, item_id, category, t from kept2, (values ({TARGET}), ({TARGET + 1})) as tt(t) where m < t group by all having sum(qty) > 0),
c as (select *, case t when {TARGET} then date '1998-12-01' else date '1999-01-01' end as a, case t when {TARGET} then date '1998-12-31' else date '1999-01-31' end as b, date '1999-02-16' as d from u join cc using (category)),
f as (select *, cast(a <= d - 1 and b >= d - 60 as int) as p60, cast(a <= d - 1 and b >= d - 45 as int) as p45, cast(a <= d - 1 and b >= d - 30 as int) as p30 from c)
select location, item_id, t, cast(d - a as double) as days_to_tet, round((d - a) / 7.0, 6) as weeks_to_tet, cast(abs(d - a) as double) as abs_days_to_tet, p60 as is_pre_tet_60d, p45 as is_pre_tet_45d, p30 as is_pre_tet_30d,
 cast(year(a) = year(d) and month(a) = month(d) as int) as is_tet_month, cast(a <= d + 30 and b >= d as int) as is_post_tet_30d,
 case when p60 = 1 then category_code + 1 else 0 end as category_pre_tet_60d_code, case when p45 = 1 then category_code + 1 else 0 end as category_pre_tet_45d_code, case when p30 = 1 then category_code + 1 else 0 end as category_pre_tet_30d_code from f"""
SCALES = "(select round(0.7 + i * 0.025, 4)::double as scale from range(19) as x(i))"
GROUP = "case when recent <= 0.5 then 'very_low' when recent <= 1 then 'low' when recent <= 5 then 'mid' when recent <= 20 then 'high' else 'very_high' end"
GROUP3 = "case when recent <= 1 then 'low' when recent <= 5 then 'mid' else 'high' end"
FIVE = ("very_low", "low", "mid", "high", "very_high")
CAP_GRID = "(values ('none'), ('pair'), ('item'), ('location'), ('min_item_location')) a(clip_kind), (values (1.0::double), (1.25::double), (1.5::double), (2.0::double), (3.0::double)) b(clip_mult), (values (0.0::double), (0.1::double), (0.25::double), (0.5::double), (1.0::double)) c(floor)"
WEIGHTS = """g0 as (select a, b, c from range(6) x(a), range(6) y(b), range(6) z(c) where a + b + c > 0), g as (select cast(a * 36 + b * 6 + c - 1 as int) as ordinal, a / (a + b + c)::double as wr, b / (a + b + c)::double as wl, c / (a + b + c)::double as wb from g0),
 o as (select g.*, y, greatest(pred_raw * wr + pred_log * wl + pred_base * wb, 0) as p from sr, g where y > 0)"""


def group_scale(group: str, names: tuple[str, ...]) -> str:
    """gs: the best scale of each group over sr, where there is none the best of all."""
    values = ", ".join(f"('{n}')" for n in names)
    return f"""sq as (select {group} as activity, scale, y, pred_base * scale as p from sr, {SCALES}), gl as (select scale from sq group by 1 order by avg(abs(y - p) / greatest(y, 1e-6)) filter (where y > 0), avg(abs(y - p)), scale limit 1),
 ga as (select activity, scale, sum(abs(y - p) / greatest(y, 1e-6)) as total, avg(abs(y - p) / greatest(y, 1e-6)) * 100 as m from sq where y > 0 group by 1, 2), gb as (select *, row_number() over (partition by activity order by total, scale) as k from ga),
 gs as (select n.activity, coalesce(b.scale, (select scale from gl)) as group_scale, m as group_mape from (values {values}) n(activity) left join gb b on n.activity = b.activity and k = 1)"""


MODES = {"none": "pred_raw", "inv_y": "pred_base", "inv_sqrt_y": "((pred_raw + pred_base) / 2)"}
MIXES = {"raw_only": "{m}", "raw_log": "{m} * 0.5 + pred_log * 0.5", "raw_baseline_80_20": "{m} * 0.8 + pred_base * 0.2", "raw_baseline_70_30": "{m} * 0.7 + pred_base * 0.3"}
CANDIDATES = f"""{SCORED}, ac as (select *, {GROUP} as g from sr),
 lg as (select '' as mode, 'log' as blend, y, g, pred_log as p from ac union all {" union all ".join(f"select '{n}', '{b}', y, g, {e.format(m=c)} from ac" for n, c in MODES.items() for b, e in MIXES.items())}),
 er as (select mode, blend, scale, g, count(*) as n, sum(abs(y - greatest(p * scale, 0))) as ae, sum(abs(y - greatest(p * scale, 0)) / greatest(y, 1e-6)) filter (where y > 0) as ape, count(*) filter (where y > 0) as np from lg, {SCALES} group by all),
 wh as (select mode, blend, scale, sum(ape) / sum(np) * 100 as mape, sum(ae) / sum(n) as mae from er group by all),
 tp as (select mode, blend, scale, mape, mae from (select *, row_number() over (partition by mode, blend order by round(mape, 9), round(mae, 9), scale) as k from wh) where k = 1),
 rw as (select mode, scale as s0, mape as p0, mae as a0 from tp where blend = 'raw_only'),
 gp as (select *, row_number() over (partition by mode, g order by round(ape, 9), scale) as k from er where blend = 'raw_only' and np > 0),
 gs as (select r.mode, n.g, coalesce(gp.scale, s0) as group_scale, gp.ape / gp.np * 100 as group_mape from rw r, (values {", ".join(f"('{n}')" for n in FIVE)}) n(g) left join gp on gp.mode = r.mode and gp.g = n.g and gp.k = 1),
 gr as (select e.mode, sum(ape) / sum(np) * 100 as mape, sum(ae) / sum(n) as mae from er e join gs on e.mode = gs.mode and e.g = gs.g and e.scale = gs.group_scale where blend = 'raw_only' group by 1),
 fa as (select t.*, s0, p0, a0, blend = 'raw_log' and p0 <= (select mape from tp where blend = 'log') as falls from tp t join rw using (mode) where blend not in ('raw_only', 'log')),
 ct as (select 'raw_' || mode as candidate, mode as weight_mode, 'raw_only' as blend_mode, 'global_scale' as postprocess, s0 as scale, p0 as mape, a0 as mae, null::boolean as beats_global from rw
  union all select mode || '_' || blend, mode, case when falls then 'raw_only' else blend end, 'global_scale', case when falls then s0 else scale end, case when falls then p0 else mape end, case when falls then a0 else mae end, null from fa
  union all select 'raw_' || mode || '_group', mode, 'raw_only', 'group_scale', null, mape, mae, mape < p0 from gr join rw using (mode))"""
REFILL = f"""{BASELINE}, en as ({ENGAGED}), rt as (select location, item_id, atc_count_7d, cast(s28 as double) / (cast(atc_count_28d as double) + 1e-6) as rate from pw join en using (item_id))"""
REFILLED = "case when p = 0 and coalesce(atc_count_7d, 0) > 0 then atc_count_7d * (31 / 7.0::double) * least(greatest(coalesce(rate, 0), 0), 1) else p end"
BLENDS = {"raw_only": "pred_raw", "raw_log": "pred_raw * 0.5 + pred_log * 0.5", "raw_baseline_80_20": "pred_raw * 0.8 + pred_base * 0.2", "raw_baseline_70_30": "pred_raw * 0.7 + pred_base * 0.3"}

SQL = {
    "sales_view": f"with {VIEWS} select location, item_id, sale_date, cast(quantity as bigint) as quantity, cast(price as double) as price from sales",
    "items_view": f"with {VIEWS} select item_id, category, brand, cast(item_price as double) as item_price, sale_status from items",
    "engagement_view": f"with {VIEWS} select item_id, event_date, event_type, cast(quantity as bigint) as quantity from engagement",
    "rolling_sum_windows": pairs(CLASSIC["sums"]), "rolling_mean_windows": pairs(CLASSIC["means"]), "rolling_std_daily": pairs(CLASSIC["std"]),
    "nonzero_days": pairs(CLASSIC["active"]), "days_since_last_sale": pairs(CLASSIC["since"]), "avg_price_ratio": pairs(CLASSIC["price"]), "trend_ratios": pairs(CLASSIC["trend"]),
    "last_price": f"with {PAIRS} {LAST_PRICE}",
    "item_features": f"with {PAIRS} {ITEM}", "location_features": f"with {PAIRS} {PLACE}", "category_share": f"with {PAIRS} {CATEGORY}",
    "engagement_counts": f"with {VIEWS} {ENGAGED}",
    "engagement_rates": f"with {PAIRS}, en as ({ENGAGED}) select location, item_id, {RATES} from pw join en using (item_id)",
    "calendar_features": f"select {CALENDAR}",
    "classic_features": CLASSIC_FRAME,
    "next_month_target": f"with {PAIRS}, la as ({LABEL}) select location, item_id, coalesce(sales_next_month, 0) as sales_next_month, coalesce(revenue_next_month, 0) as revenue_next_month from pw left join la using (location, item_id)",
    "last_month_baseline": f"with {PAIRS} select location, item_id, cast(sum(quantity) as double) as pred_lastmonth from past where {LAST_MONTH} group by 1, 2",
    "rolling_baseline": f"with {PAIRS} select location, item_id, " + ", ".join(f"round(cast(s{n} as double) * 31 / {n}, 6) as pred_rolling{n}d" for n in (28, 56, 90)) + " from pw where c90 > 0",
    "item_global_avg": f"with {BASELINE} select item_id, round(item_global_avg, 6) as item_global_avg from av",
    "baseline_submission": f"with {BASELINE} select location, item_id, round(prediction, 6) as prediction from bl",
    "sale_status_zeroing": f"with {BASELINE} select location, item_id, case when sale_status = 0 then 0 else round(prediction, 6) end as prediction from bl left join items using (item_id)",
    "purchase_monthly": f"with {CUBE} select location, item_id, m, qty, cast(rev as double) as rev from cube",
    "event_monthly": f"with {CUBE} select * from evm",
    "month_cube_all_grains": f"""with {CUBE}, w as (select c.*, coalesce(category, '__missing__') as category, coalesce(brand, '__missing__') as brand from cube c left join items using (item_id))
select case when grouping(location) = 0 and grouping(item_id) = 0 then 'pair' when grouping(item_id) = 0 then 'item' when grouping(location) = 0 then 'location' when grouping(category) = 0 then 'category' else 'brand' end as grain,
 location, item_id, category, brand, m, cast(sum(qty) as bigint) as qty, cast(sum(rev) as double) as rev from w group by grouping sets ((location, item_id, m), (item_id, m), (location, m), (category, m), (brand, m))""",
    "active_locs_items": f"with {CUBE} select 'item' as grain, item_id as key, m, count(distinct location) filter (where qty > 0) as active from cube group by 2, 3 union all select 'location', cast(location as varchar), m, count(distinct item_id) filter (where qty > 0) from cube group by 2, 3",
    "month_pivot": f"with {CUBE} select location, item_id, " + ", ".join(f"cast(coalesce(sum(qty) filter (where m = {m}), 0) as bigint) as m{m - START + 1:02d}" for m in range(START, TARGET + 1)) + " from cube group by 1, 2",
    "item_price_median": f"with {CUBE} select item_id, round(case when sale_status = 0 and item_price > 0 then cast(item_price as double) else coalesce(median(cast(rev as double) / qty), 0) end, 6) as price from cube left join items using (item_id) where qty > 0 group by item_id, sale_status, item_price",
    "label_codes": f"with {VIEWS} select 'item_id' as field, item_id as value, cast(dense_rank() over (order by item_id) - 1 as int) as code from items union all select 'brand', brand, cast(dense_rank() over (order by brand) - 1 as int) from (select distinct brand from items)",
    "lag_features": pair_series("lag1", "lag2", "lag3", "lag6"), "roll3_stats": pair_series("roll_median_3", "roll_std_3", "roll_max_3", "roll_min_3"),
    "roll_means": pair_series("roll_mean_3", "roll_mean_6"), "sale_recency": pair_series("months_since_last_sale", "number_of_sale_months", "zero_sale_months"), "growth_trend": pair_series("trend_3", "growth_ratio", "lag1_to_roll3"),
    "conversion_ratios": from_frame("round(atc_to_view_lag1, 6) as atc_to_view_lag1, round(purchase_to_atc_lag1, 6) as purchase_to_atc_lag1, round(atc_to_view_roll3, 6) as atc_to_view_roll3, round(purchase_to_atc_roll3, 6) as purchase_to_atc_roll3"),
    "event_extras": from_frame(EVENT),
    "location_event_extras": f"""with {FRAME}, evp as (select cast(day(event_date) % 5 as int) as location, item_id, cast(year(event_date) * 12 + month(event_date) as int) as m, count(*) filter (where event_type = 'view_item') as view_count, count(*) filter (where event_type = 'add_to_cart') as atc_count from engagement group by 1, 2, 3),
 sp as ({series("evp", "location, item_id", [("li_view", "view_count", False), ("li_atc", "atc_count", False)], [TARGET])}), x as (select fr.*, {", ".join(f"coalesce({c}, 0) as {c}" for c in ("li_view_lag1", "li_view_roll_mean_3", "li_atc_lag1", "li_atc_roll_mean_3"))} from fr left join sp using (location, item_id))
select location, item_id, view_item_lag1 as item_view_lag1, li_view_lag1, round(li_view_roll_mean_3, 6) as li_view_roll_mean_3, li_atc_lag1, round(li_atc_roll_mean_3, 6) as li_atc_roll_mean_3,
 round(li_atc_roll_mean_3 / (li_view_roll_mean_3 + 1), 6) as li_atc_per_view, round(li_qty_roll_mean_3 / (li_view_roll_mean_3 + 1), 6) as li_purchase_per_view, round(li_qty_roll_mean_3 / (li_atc_roll_mean_3 + 1), 6) as li_purchase_per_atc from x""",
    "new_year_features": YEAR,
    "weighted_baseline": from_frame("baseline_lag1, round(baseline_rolling3, 6) as baseline_rolling3, round(baseline_weighted, 6) as baseline_weighted"),
    "monthly_features": f"with {FRAME}, {CODES}, z as (select * from fl join cl using (location) join ci using (item_id) join cc using (category) join cb using (brand)) {ROUND} from z",
    "training_frames_multi_target": f"with {MULTI} {ROUND} from fl",
    "ground_truth": f"with {VIEWS}, {TRUTH} select * from tr",
    "evaluate_sales": f"with {EVALUATED} select {mae('p', digits=6)} as mae_sales, {mape('p', digits=6)} as mape_sales from ev",
    "evaluate_revenue": f"with {EVALUATED} select {mae('e', 'r')} as mae_revenue, {mape('e', 'r')} as mape_revenue from ev",
    "score_active_universe": f"with {SCORED} select count(*) as n_pairs, count(*) filter (where y > 0) as n_positive, {mae('pred_base')} as mae_quantity, {mape('pred_base')} as mape_quantity, {mae('(pred_base * coalesce(price, 0))', 'r')} as mae_revenue, {mape('(pred_base * coalesce(price, 0))', 'r')} as mape_revenue from sr",
    "validation_predictions": f"with {SCORED} select location, item_id, y as y_true, round(pred_raw, 6) as pred_raw, pred_log, round(pred_base, 6) as pred_base from sr",
    "group_metrics": f"""with {SCORED}, g as (select case when y <= 0 then 'y=0' when y <= 1 then '0<y<=1' when y <= 5 then '1<y<=5' else 'y>5' end as target_group, count(*) as n_pairs, {mae('pred_base')} as mae_quantity, {mape('pred_base')} as mape_quantity from sr group by 1)
select target_group, coalesce(n_pairs, 0) as n_pairs, mae_quantity, mape_quantity from (values ('y=0'), ('0<y<=1'), ('1<y<=5'), ('y>5')) n(target_group) left join g using (target_group)""",
    "distribution_metrics": f"with {SCORED} select round(avg(pred_base), 4) as mean_prediction, round(min(pred_base), 4) as min_prediction, round(avg(cast(pred_base < 0.1 as double)) * 100, 4) as below_0_1, round(avg(cast(pred_base < 0.5 as double)) * 100, 4) as below_0_5, round(avg(cast(pred_base < 1 as double)) * 100, 4) as below_1_0 from sr",
    "validation_table": f"with {SCORED} " + " union all ".join(f"select '{m}' as model, {mae(m)} as mae_quantity, {mape(m)} as mape_quantity from sr" for m in ("pred_raw", "pred_log", "pred_base")),
    "q99_caps": f"with {CAPS} select 'item' as grain, item_id as key, round(cap_item, 6) as cap, n_item as n from cpi union all select 'location', cast(location as varchar), round(cap_location, 6), n_location from cpl union all select 'global', '', round(cap_global, 6), 0 from cpg",
    "apply_caps": f"with {CAPS} select location, item_id, " + ", ".join(f"round({cut(repr(k), '1.25::double')}, 6) as capped_{k}" for k in ("none", "pair", "item", "location", "min_item_location")) + " from cr",
    "safe_postprocess": f"""with {CAPS}, o as (select 'none' as postprocess, y, pred_base as p from cr union all select 'global_q99', y, least(pred_base, cap_global) from cr, cpg
 union all select 'item_q99', y, case when n_item >= 3 and cap_item > 0 then least(pred_base, cap_item) else pred_base end from cr union all select 'location_q99', y, case when n_location >= 3 and cap_location > 0 then least(pred_base, cap_location) else pred_base end from cr)
select postprocess, {mae('p')} as mae_quantity, {mape('p')} as mape_quantity from o group by 1""",
    "alpha_scale_grid": f"""with {SCORED}, g as (select cast(a * 12 + s as int) as ordinal, a / 20.0::double as alpha, round(0.75 + s * 0.05, 4)::double as scale from range(21) x(a), range(12) z(s)), o as (select g.*, y, greatest((alpha * pred_raw + (1 - alpha) * pred_base) * scale, 0) as p from sr, g)
select ordinal, round(alpha, 4) as alpha, scale, {mae('p')} as mae_quantity, {mape('p')} as mape_quantity from o group by ordinal, alpha, scale""",
    "alpha_scale_best": f"""with {SCORED}, g as (select cast(a * 12 + s as int) as ordinal, a / 20.0::double as alpha, round(0.75 + s * 0.05, 4)::double as scale from range(21) x(a), range(12) z(s)), o as (select g.*, y, greatest((alpha * pred_raw + (1 - alpha) * pred_base) * scale, 0) as p from sr, g),
 e as (select ordinal, round(alpha, 4) as alpha, scale, {mape('p')} as mape_quantity from o group by ordinal, o.alpha, scale) select alpha, scale, mape_quantity from e order by mape_quantity, ordinal limit 1""",
    "postprocess_grid": f"""with {CAPS}, g as (select * from (values ('none'), ('pair'), ('item'), ('location'), ('min_item_location')) a(clip_kind), (values (1.0::double), (1.25::double), (1.5::double), (2.0::double), (3.0::double)) b(clip_mult), (values (0.0::double), (0.1::double), (0.25::double), (0.5::double), (1.0::double)) c(floor)),
 o as (select g.*, y, {cut('clip_kind', 'clip_mult')} as c from cr, g), p as (select *, case when c < floor then 0 else c end as p from o)
select clip_kind, clip_mult, floor, {mae('p')} as mae_quantity, {mape('p')} as mape_quantity from p group by 1, 2, 3""",
    "global_scale_sweep": f"with {SCORED}, o as (select scale, y, pred_base * scale as p from sr, {SCALES}) select scale, {mae('p')} as mae_quantity, {mape('p')} as mape_quantity from o group by 1",
    "group_scale_tuning": f"with {SCORED}, {group_scale(GROUP, FIVE)} select activity, group_scale, round(group_mape, 4) as group_mape from gs",
    "group_scale_tuning_three": f"with {SCORED}, {group_scale(GROUP3, ('low', 'mid', 'high'))} select activity, group_scale, round(group_mape, 4) as group_mape from gs",
    "apply_group_scales": f"with {SCORED}, {group_scale(GROUP, FIVE)}, ac as (select *, {GROUP} as activity from sr) select location, item_id, round(greatest(pred_base * group_scale, 0), 6) as prediction from ac join gs using (activity)",
    "mean_ensemble": f"with {SCORED} select location, item_id, round((pred_raw + pred_log + pred_base) / 3, 6) as prediction from sr",
    "blend_weight_grid": f"""with {SCORED}, {WEIGHTS}
select ordinal, round(wr, 4) as w_pred_raw, round(wl, 4) as w_pred_log, round(wb, 4) as w_pred_base, {mape('p')} as mape_quantity from o group by ordinal, o.wr, o.wl, o.wb""",
    "fixed_blends": f"with {SCORED} select location, item_id, " + ", ".join(f"round({e}, 6) as {n}" for n, e in BLENDS.items()) + " from sr",
    "candidate_table": f"with {CANDIDATES} select candidate, weight_mode, blend_mode, postprocess, round(scale, 4) as scale, round(mape, 4) as mape_quantity, round(mae, 4) as mae_quantity, beats_global from ct",
    "candidate_group_scales": f'with {CANDIDATES} select mode as weight_mode, g as "group", round(group_scale, 4) as group_scale, round(group_mape, 4) as group_mape from gs',
    "extra_candidates": f"""with {CANDIDATES}, w as (select *, coalesce(beats_global, false) or blend_mode in ('raw_baseline_80_20', 'raw_baseline_70_30') as wanted from ct),
 e as (select *, row_number() over (order by round(mape, 9), round(mae, 9), candidate) as k from w where case when (select bool_or(wanted) from w) then wanted else candidate like '%\\_group' escape '\\' end)
select candidate, weight_mode, blend_mode, postprocess, round(scale, 4) as scale, round(mape, 4) as mape_quantity, round(mae, 4) as mae_quantity, beats_global, k = 1 as is_choice from e""",
    "tuned_final": f"""with {CAPS}, o as (select clip_kind, clip_mult, floor, y, {cut('clip_kind', 'clip_mult')} as c from cr, {CAP_GRID}), p as (select *, case when c < floor then 0 else c end as p from o),
 tu as (select clip_kind, clip_mult, floor from p group by 1, 2, 3 order by {mape('p', digits=9).replace('9)', '6)')}, list_position(['none', 'pair', 'item', 'location', 'min_item_location'], clip_kind), clip_mult, floor limit 1),
 fi as (with {frame([TARGET + 1])} select location, item_id, baseline_weighted as pred_base from fr),
 fc as (with a as (select location, item_id, quantile_cont(qty, 0.99) as cap_pair from kept group by 1, 2), b as (select item_id, quantile_cont(qty, 0.99) as cap_item from kept group by 1), c as (select location, quantile_cont(qty, 0.99) as cap_location from kept group by 1)
  select * from fi left join a using (location, item_id) left join b using (item_id) left join c using (location)),
 z as (select location, item_id, floor, {cut('clip_kind', 'clip_mult')} as c from fc, tu) select location, item_id, round(case when c < floor then 0 else c end, 6) as prediction from z""",
    "final_blend": f"""with {SCORED}, {WEIGHTS}, wt as (select wr, wl, wb from o group by ordinal, wr, wl, wb order by round(avg(abs(y - p) / greatest(abs(y), 1e-6)) * 100, 6), ordinal limit 1),
 fi as (with {frame([TARGET + 1])} select location, item_id, baseline_rolling3 as a, baseline_lag1 as b from fr),
 fb as (with {BASELINE.replace("date '1998-12-01'", "date '1999-01-01'").replace("date '1998-11-01'", "date '1998-12-01'").replace(CUT, "date '1998-12-31'")} select location, item_id, case when sale_status = 0 then 0 else prediction end as c from bl left join items using (item_id))
select location, item_id, round(greatest(coalesce(a, 0) * wr + coalesce(b, 0) * wl + coalesce(c, 0) * wb, 0), 6) as prediction from fi left join fb using (location, item_id), wt""",
    "monthly_cap_90d": f"with {PAIRS} select location, item_id, cast(max(q) as double) * 31 * 2 as max_monthly_cap from dt where {inside(90)} group by 1, 2",
    "floor_and_refill": f"with {REFILL}, f as (select location, item_id, case when prediction < 30 then 0 else prediction end as p from bl) select location, item_id, round({REFILLED}, 6) as prediction from f left join rt using (location, item_id)",
    "classic_postprocess": f"""with {REFILL}, cp as (select location, item_id, cast(max(q) as double) * 31 * 0.05::double as cap from dt where {inside(90)} group by 1, 2),
 c as (select location, item_id, case when cap is not null then least(prediction, cap) else prediction end as p0 from bl left join cp using (location, item_id)), f as (select location, item_id, case when p0 < 0.5 then 0 else p0 end as p from c)
select location, item_id, case when sale_status = 0 then 0 else round({REFILLED}, 6) end as prediction from f left join rt using (location, item_id) left join items using (item_id)""",
    "sample_counts": f"with {MULTI} select count(*) filter (where target > 0) as positives, cast(least(count(*) filter (where target <= 0), ceil(count(*) filter (where target > 0) * 0.5)) as bigint) as zeros from fl",
    "sample_weights": f"with {MULTI} select location, item_id, t, case when target <= 0 then 0.3::double else round(1 / greatest(target, 1), 6) end as inv_y, case when target <= 0 then 0.3::double else round(1 / sqrt(greatest(target, 1)), 6) end as inv_sqrt_y from fl",
    "sampling_diagnostic": f"with {MULTI} select t, count(*) as n_rows, count(*) filter (where target > 0) as positives, count(*) filter (where target <= 0) as zeros, round(avg(cast(target > 0 as double)), 6) as positive_rate, sum(target) as target_sum from fl group by 1",
    "sample_month_counts": f"""with {MULTI}, c as (select t, count(*) filter (where target > 0) as p, count(*) filter (where target <= 0) as z from fl group by 1), d as (select *, least(z, ceil(p * 0.5)) as want from c),
 e as (select *, case when p + want <= 555 then p else least(p, 370) end as a from d), f as (select *, case when p + want <= 555 then want else least(z, 555 - a) end as b from e)
select t, cast(case when b = 0 then least(p, 555) else a end as bigint) as positives, cast(b as bigint) as zeros from f""",
    "sample_checks": f"""with {MULTI}, c as (select count(*) filter (where target > 0) as p, count(*) filter (where target <= 0) as z from fl), m as (select t, count(*) filter (where target > 0) as p, count(*) filter (where target <= 0) as z from fl group by 1)
select 'positive_first' as sample, least(p + z, 3000) as n_rows, least(p, 3000) as positives, 0 as unknown, 0 as twice from c union all select 'negative_ratio', p + least(z, cast(ceil(p * 0.5) as bigint)), p, 0, 0 from c
 union all select 'month_budget', cast(sum(least(p + z, 555)) as bigint), cast(sum(least(p, 555)) as bigint), 0, 0 from m""",
    "data_audit_profile": f"with {VIEWS} " + " union all ".join(f"select '{c}' as column, '{k}' as kind, count(*) as n_rows, count(*) - count({c}) as n_nulls, count(distinct {c}) as n_distinct, cast(min({e}) as varchar) as least, cast(max({e}) as varchar) as greatest from sales" for c, e, k in (("location", "location", "int"), ("item_id", "item_id", "string"), ("sale_date", "sale_date", "date"), ("quantity", "cast(quantity as bigint)", "bigint"))),
    "monthly_summary": f"with {VIEWS} select strftime(sale_date, '%Y-%m') as month, count(*) as n_rows, cast(sum(quantity) as bigint) as quantity, cast(sum(coalesce(quantity * price, 0)) as double) as revenue, count(distinct item_id) as n_items, count(distinct location) as n_locations from sales group by 1",
    "event_type_counts": f"with {VIEWS} select event_type, count(*) as n from engagement group by 1",
    "submission_check": f"""with {BASELINE} select 'columns' as check, cast(0 as bigint) as n union all select 'nulls', count(*) filter (where location is null or item_id is null or prediction is null) from bl union all select 'not_finite', count(*) filter (where isnan(prediction) or isinf(prediction)) from bl
 union all select 'negative', count(*) filter (where prediction < 0) from bl union all select 'repeated_keys', count(*) - count(distinct (location, item_id)) from bl union all select 'status_zero_positive', count(*) from bl join items using (item_id) where sale_status = 0 and prediction > 0""",
    "duplicate_keys": f"with {VIEWS} select location, item_id, sale_date, count(*) as n_rows from sales group by 1, 2, 3 having count(*) > 1",
    "top_predictions": f"with {BASELINE} select location, item_id, round(prediction, 6) as prediction from bl order by 3 desc, location, item_id limit 10",
    "prediction_variants": f"with {SCORED} select location, item_id, variant, round(greatest(case variant when 'control' then pred_log else pred_base * f end, 0), 6) as prediction from sr, (values ('control', 1.0::double), ('raw', 1.0::double), ('best', 0.9::double), ('best_minus', 0.9::double - 0.025::double), ('best_plus', 0.9::double + 0.025::double)) v(variant, f)",
    "compare_runs": f"with {SCORED}, g as (select *, unnest([case when y <= 0 then 'y=0' when y <= 1 then '0<y<=1' when y <= 5 then '1<y<=5' else 'y>5' end, 'all']) as target_group from sr) " + " union all ".join(f"select '{m}' as model, target_group, count(*) as n_pairs, {mae(m)} as mae_quantity, {mape(m)} as mape_quantity from g group by 2" for m in ("pred_raw", "pred_log", "pred_base")),
    "submission_statistics": f"with {BASELINE} select count(*) as n_rows, round(min(prediction), 6) as least, round(max(prediction), 6) as greatest, round(avg(prediction), 6) as mean, count(*) filter (where prediction = 0) as zeros, count(*) filter (where prediction > 0) as nonzero from bl",
    "floored_count": f"with {BASELINE} select count(*) as n_floored from bl where prediction > 0 and prediction < 30",
    "universe_summary": f"""with {CUBE}, p as (select location, item_id from cube group by 1, 2 having sum(qty) > 0), k as (select p.*, coalesce(sale_status, 1) <> 0 as keep from p left join items using (item_id))
select count(*) as seen_pairs, count(*) filter (where keep) as kept_pairs, count(*) filter (where not keep) as status_zero_pairs, count(distinct location) filter (where keep) as active_locations, count(distinct item_id) filter (where keep) as active_items from k""",
    "check_candidates": f"""with {BASELINE}, c as (select output, checked, prediction * f as p, location, item_id from bl, (values ('base', 'base', 1.0::double), ('scaled', 'scaled', -0.5::double), ('absent_group', 'base', 1.0::double)) v(output, checked, f)),
 n as (select output, checked, count(*) filter (where location is null or item_id is null or p is null) as nulls, count(*) filter (where isnan(p) or isinf(p)) as not_finite, count(*) filter (where p < 0) as negative, count(*) - count(distinct (location, item_id)) as repeated_keys,
  count(*) filter (where p > 0 and item_id in (select item_id from items where sale_status = 0)) as status_zero_positive, cast(0 as bigint) as columns from c group by 1, 2)
select output, checked, x.k as check, x.n from (select output, checked, unnest([{', '.join(f"{{'k': '{k}', 'n': n.{k}}}" for k in ('columns', 'nulls', 'not_finite', 'negative', 'repeated_keys', 'status_zero_positive'))}]) as x from n) union all select 'absent', '', 'missing', 1""",
    "normalised_output": f"with {BASELINE} select cast(location as bigint) as location, item_id, round(greatest(prediction - 20, 0), 6) as prediction from bl",
    "output_frame": f"with {BASELINE} select cast(location as bigint) as location, item_id, round(prediction, 6) as prediction from bl",
}

PURCHASE_VIEWS = f"""
sales as (select location, {item_sql()} as item_id, cast(updated_date as date) as sale_date, cast(quantity as decimal(18,0)) as quantity, cast({price_sql()} as decimal(20,2)) as price from transaction_full_2025
 where {type_sql()} = 'purchase' and location >= 0 and {item_sql()} is not null and updated_date is not null),
wares as (select item_id, category, brand, item_price, sale_status from (select *, row_number() over (partition by item_id order by sale_status nulls first, item_price nulls first, category, brand) as k
 from (select {item_sql()} as item_id, coalesce(category_l1, '__missing__') as category, coalesce(brand, '__missing__') as brand, cast({price_sql()} as decimal(20,2)) as item_price, coalesce(sale_status, 0) as sale_status from items) where item_id is not null) where k = 1),
engagement as (select {item_sql()} as item_id, cast(event_date as date) as event_date, nullif({type_sql()}, '') as event_type, cast(quantity as decimal(18,0)) as quantity from event_full_2025 where {item_sql()} is not null and event_date is not null)"""


def over_purchases(sql: str) -> str:
    """The same SQL over the purchase, event and item tables: other views, dates and months 27 years later."""
    sql = re.sub(r"\bitems\b", "wares", sql.replace(VIEWS, "@views")).replace("@views", PURCHASE_VIEWS)  # items is a table here
    sql = re.sub(r"'(199\d)-(\d\d)-", lambda m: f"'{int(m[1]) + 27}-{m[2]}-", sql).replace("= 1998", "= 2025")
    sql = re.sub(r"\b239[78]\d\b", lambda m: str(int(m[0]) + 27 * 12), sql)
    return re.sub(r", 6\)", ", 6) + 0", sql)  # no negative zeros
