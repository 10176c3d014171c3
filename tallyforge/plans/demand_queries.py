"""Queries of the demand engine over the star schema, and their SQL in demand_sql."""

import datetime
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import DEFAULTS
from tallyforge.operators import baselines as B
from tallyforge.operators import cubes as C
from tallyforge.operators import models as MO
from tallyforge.operators import monthly as M
from tallyforge.operators import postprocess as P
from tallyforge.operators import quality as Q
from tallyforge.operators import sampling as S
from tallyforge.operators import scoring as E
from tallyforge.operators import tuning as G
from tallyforge.operators import windows as W
from tallyforge.plans.demand_sql import SQL as SQL, over_purchases
from tallyforge.sources import sinks as K
from tallyforge.sources.tables import scratch_path, settled, table
from tallyforge.sources.views import purchase_engagement, purchase_items, purchase_sales, star_engagement, star_items, star_sales



@dataclass(frozen=True)
class Schema:
    """Where the demand engine's three views come from, and the dates of its queries."""

    sales: Callable[[SparkSession, str], DataFrame]
    items: Callable[[SparkSession, str], DataFrame]
    engagement: Callable[[SparkSession, str], DataFrame]
    cutoff: datetime.date

    def rounded(self, df: DataFrame, digits: int = 6) -> DataFrame:
        return df.selectExpr(*(f"round(`{c}`, {digits}) as `{c}`" if k == "double" else f"`{c}`" for c, k in df.dtypes))

    @property
    def start(self) -> int:
        return self.cutoff.year * 12 + 1

    @property
    def target(self) -> int:
        return self.cutoff.year * 12 + self.cutoff.month + 1

    @property
    def targets(self) -> list[int]:
        """The months with three months of history, the last one included."""
        return list(range(self.start + 3, self.target + 1))

    @property
    def target_day(self) -> datetime.date:
        return C.month_start(self.target)

    @property
    def last_day(self) -> datetime.date:
        """The last day of the target month: the cutoff of the final period."""
        return C.month_start(self.target + 1) - datetime.timedelta(days=1)


STAR = Schema(star_sales, star_items, star_engagement, datetime.date(1998, 11, 30))
PURCHASES = Schema(
    lambda spark, d: purchase_sales(table(spark, d, "transaction_full_2025")), lambda spark, d: purchase_items(table(spark, d, "items")),
    lambda spark, d: purchase_engagement(table(spark, d, "event_full_2025")), datetime.date(2025, 11, 30),
)
PAIR = ["location", "item_id"]
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _past(spark: SparkSession, d: str, s: Schema = STAR) -> DataFrame:
    return s.sales(spark, d).where(F.col("sale_date") <= F.lit(s.cutoff))


def _trailing(spark: SparkSession, d: str, s: Schema = STAR) -> DataFrame:
    return W.trailing(W.day_totals(_past(spark, d, s), PAIR), PAIR, s.cutoff)


def _cube(spark: SparkSession, d: str, s: Schema = STAR, last: int | None = None) -> DataFrame:
    return C.sales_months(s.sales(spark, d), s.start, last or s.target)


def _settled_cube(spark: SparkSession, d: str, s: Schema = STAR, last: int | None = None) -> DataFrame:
    """The pair cube as a written table: the fact table is read once, however many grains are made of it."""
    return settled(_cube(spark, d, s, last))


def _events(spark: SparkSession, d: str, s: Schema = STAR) -> DataFrame:
    return C.engagement_months(s.engagement(spark, d), s.start, s.target)


def _frame(spark: SparkSession, d: str, s: Schema = STAR, targets=None, cube: DataFrame | None = None, **kw) -> DataFrame:
    targets = list(targets or [s.target])
    return M.monthly_frame(_cube(spark, d, s, max(targets)) if cube is None else cube, _events(spark, d, s), s.items(spark, d), targets, s.start, **kw)


def _scored(spark: SparkSession, d: str, s: Schema = STAR, cube: DataFrame | None = None, target: int | None = None) -> DataFrame:
    """Evaluation rows with three predictions: raw, log (stand-ins for models) and the weighted baseline."""
    cube = _settled_cube(spark, d, s) if cube is None else cube
    frame = _frame(spark, d, s, cube=cube, label=False, codes=False, blocks=("item", "location"))
    predictions = frame.select(*PAIR, F.col("baseline_rolling3").alias("pred_raw"), F.col("baseline_lag1").alias("pred_log"), F.col("baseline_weighted").alias("pred_base"), F.col("li_qty_roll_mean_3").alias("recent"))
    items = s.items(spark, d)
    return E.evaluation_rows(M.with_status(cube, items), predictions, s.target, ["pred_raw", "pred_log", "pred_base", "recent"], C.unit_prices(M.with_status(cube, items), items))


@query
def sales_view(spark, d, s=STAR):
    return s.sales(spark, d).select("location", "item_id", "sale_date", F.col("quantity").cast("bigint").alias("quantity"), F.col("price").cast("double").alias("price"))


@query
def items_view(spark, d, s=STAR):
    return s.items(spark, d).withColumn("item_price", F.col("item_price").cast("double"))


@query
def engagement_view(spark, d, s=STAR):
    return s.engagement(spark, d).withColumn("quantity", F.col("quantity").cast("bigint"))


@query
def rolling_sum_windows(spark, d, s=STAR):
    return _trailing(spark, d, s).select(*PAIR, *(f"sales_sum_{n}d" for n in DEFAULTS.sum_days), *(f"revenue_sum_{n}d" for n in DEFAULTS.revenue_days))


@query
def rolling_mean_windows(spark, d, s=STAR):
    return _trailing(spark, d, s).select(*PAIR, *(f"sales_mean_{n}d" for n in DEFAULTS.sum_days))


@query
def rolling_std_daily(spark, d, s=STAR):
    return s.rounded(_trailing(spark, d, s).select(*PAIR, *(f"sales_std_{n}d" for n in DEFAULTS.std_days)))


@query
def nonzero_days(spark, d, s=STAR):
    return _trailing(spark, d, s).select(*PAIR, *(f"sales_nonzero_days_{n}d" for n in DEFAULTS.active_days))


@query
def days_since_last_sale(spark, d, s=STAR):
    return _trailing(spark, d, s).select(*PAIR, "days_since_last_sale")


@query
def last_price(spark, d, s=STAR):
    return W.last_positive_price(_past(spark, d, s), PAIR)


@query
def avg_price_ratio(spark, d, s=STAR):
    return s.rounded(_trailing(spark, d, s).select(*PAIR, "avg_price_28d", "avg_price_90d", "price_change_28_vs_90"))


@query
def trend_ratios(spark, d, s=STAR):
    return s.rounded(_trailing(spark, d, s).select(*PAIR, "trend_7_vs_28", "trend_28_vs_90"))


@query
def item_features(spark, d, s=STAR):
    return s.rounded(W.entity_windows(W.day_totals(_past(spark, d, s), PAIR), "item_id", "location", s.cutoff, "item", "item_num_locations_sold", "item_global_trend_28_vs_90"))


@query
def location_features(spark, d, s=STAR):
    return s.rounded(W.entity_windows(W.day_totals(_past(spark, d, s), PAIR), "location", "item_id", s.cutoff, "location", "location_active_items", "location_sales_trend_28_vs_90"))


@query
def category_share(spark, d, s=STAR):
    return s.rounded(W.category_windows(W.day_totals(_past(spark, d, s), PAIR), s.items(spark, d), s.cutoff))


@query
def engagement_counts(spark, d, s=STAR):
    return W.engagement_windows(s.engagement(spark, d), s.cutoff)


@query
def engagement_rates(spark, d, s=STAR):
    sums = _trailing(spark, d, s).select(*PAIR, "sales_sum_28d")
    return s.rounded(W.engagement_ratios(sums.join(W.engagement_windows(s.engagement(spark, d), s.cutoff), "item_id")).select(*PAIR, "view_to_atc_rate_28d", "atc_to_purchase_rate_28d", "view_to_purchase_rate_28d", "recent_view_ratio", "recent_atc_ratio"))


@query
def calendar_features(spark, d, s=STAR):
    return spark.range(1).select(*(c.cast("int").alias(n) for n, c in W.calendar_columns(s.cutoff).items()))


@query
def classic_features(spark, d, s=STAR):
    return s.rounded(W.classic_frame(s.sales(spark, d), s.items(spark, d), s.engagement(spark, d), s.cutoff, s.target_day))


@query
def next_month_target(spark, d, s=STAR):
    pairs = _past(spark, d, s).select(*PAIR).distinct()
    return pairs.join(W.month_label(s.sales(spark, d), s.target_day.year, s.target_day.month, PAIR), PAIR, "left").fillna(0)


@query
def last_month_baseline(spark, d, s=STAR):
    return B.month_total(_past(spark, d, s), s.cutoff)


@query
def rolling_baseline(spark, d, s=STAR):
    return s.rounded(B.scaled_trailing(_past(spark, d, s), s.cutoff, (28, 56, 90)))


@query
def item_global_avg(spark, d, s=STAR):
    return s.rounded(B.item_average(_past(spark, d, s), s.cutoff))


def _baseline(spark, d, s=STAR):
    return B.baseline(_past(spark, d, s), s.cutoff)


@query
def baseline_submission(spark, d, s=STAR):
    return s.rounded(_baseline(spark, d, s))


@query
def sale_status_zeroing(spark, d, s=STAR):
    return s.rounded(B.zero_where_status(_baseline(spark, d, s), s.items(spark, d)))


@query
def purchase_monthly(spark, d, s=STAR):
    return _cube(spark, d, s).withColumn("rev", F.col("rev").cast("double"))


@query
def event_monthly(spark, d, s=STAR):
    return _events(spark, d, s)


@query
def month_cube_all_grains(spark, d, s=STAR):
    return C.all_grains(_cube(spark, d, s), s.items(spark, d))


@query
def active_locs_items(spark, d, s=STAR):
    cube = _cube(spark, d, s)
    items = C.grain_months(cube, "item_id").select(F.lit("item").alias("grain"), F.col("item_id").alias("key"), "m", "active")
    return items.unionByName(C.grain_months(cube, "location").select(F.lit("location").alias("grain"), F.col("location").cast("string").alias("key"), "m", "active"))


@query
def month_pivot(spark, d, s=STAR):
    return C.dense_months(_cube(spark, d, s), PAIR, "qty", s.start, s.target)


@query
def item_price_median(spark, d, s=STAR):
    return s.rounded(C.unit_prices(_cube(spark, d, s), s.items(spark, d).withColumn("item_price", F.when(F.col("sale_status") == 0, F.col("item_price")))))


@query
def label_codes(spark, d, s=STAR):
    codes = C.dictionary_codes(s.items(spark, d), "item_id", "code").select(F.lit("item_id").alias("field"), F.col("item_id").alias("value"), "code")
    return codes.unionByName(C.dictionary_codes(s.items(spark, d), "brand", "code").select(F.lit("brand").alias("field"), F.col("brand").alias("value"), "code"))


def _pair_series(spark, d, s=STAR):
    return M.series_features(_cube(spark, d, s, s.target - 1), PAIR, {"li_qty": ("qty", True)}, [s.target], s.start)


def _series_query(name, *columns):
    def f(spark, d, s=STAR):
        return s.rounded(_pair_series(spark, d, s).select(*PAIR, *(f"li_qty_{c}" for c in columns)))

    f.__name__ = name
    return query(f)


_series_query("lag_features", "lag1", "lag2", "lag3", "lag6")
_series_query("roll3_stats", "roll_median_3", "roll_std_3", "roll_max_3", "roll_min_3")
_series_query("roll_means", "roll_mean_3", "roll_mean_6")
_series_query("sale_recency", "months_since_last_sale", "number_of_sale_months", "zero_sale_months")
_series_query("growth_trend", "trend_3", "growth_ratio", "lag1_to_roll3")


@query
def conversion_ratios(spark, d, s=STAR):
    return s.rounded(_frame(spark, d, s, label=False, codes=False, blocks=("item", "events")).select(*PAIR, "atc_to_view_lag1", "purchase_to_atc_lag1", "atc_to_view_roll3", "purchase_to_atc_roll3"))


@query
def event_extras(spark, d, s=STAR):
    frame = _frame(spark, d, s, label=False, codes=False, blocks=("item", "events"), config=replace(DEFAULTS, event_features=True))
    return s.rounded(frame.select(*PAIR, *M.event_columns()))


@query
def location_event_extras(spark, d, s=STAR):
    """The pair's own event block. The star schema's events have no location: the day of the month modulo 5 stands in for it."""
    events = s.engagement(spark, d).withColumn("location", F.pmod(F.dayofmonth("event_date"), F.lit(5)))
    events = C.engagement_months(events, s.start, s.target)
    frame = M.monthly_frame(_cube(spark, d, s), events, s.items(spark, d), [s.target], s.start, label=False, codes=False, blocks=("item", "events"), config=replace(DEFAULTS, event_features=True))
    return s.rounded(frame.select(*PAIR, "item_view_lag1", "li_view_lag1", "li_view_roll_mean_3", "li_atc_lag1", "li_atc_roll_mean_3", "li_atc_per_view", "li_purchase_per_view", "li_purchase_per_atc"))


@query
def new_year_features(spark, d, s=STAR):
    frame = _frame(spark, d, s, (s.target, s.target + 1), label=False, blocks=(), config=replace(DEFAULTS, calendar_features=True))
    return s.rounded(frame.select(*PAIR, "t", "days_to_tet", "weeks_to_tet", "abs_days_to_tet", "is_pre_tet_60d", "is_pre_tet_45d", "is_pre_tet_30d", "is_tet_month", "is_post_tet_30d", *(f"category_pre_tet_{n}d_code" for n in (60, 45, 30))))


@query
def weighted_baseline(spark, d, s=STAR):
    return s.rounded(_frame(spark, d, s, label=False, codes=False, blocks=("item", "location")).select(*PAIR, "baseline_lag1", "baseline_rolling3", "baseline_weighted"))


@query
def monthly_features(spark, d, s=STAR):
    return s.rounded(_frame(spark, d, s))


@query
def training_frames_multi_target(spark, d, s=STAR):
    return s.rounded(_frame(spark, d, s, s.targets, codes=False))


def _truth(spark, d, s=STAR):
    truth = W.month_label(s.sales(spark, d), s.target_day.year, s.target_day.month, PAIR).where(F.col("sales_next_month") > 0)
    return truth.select(*PAIR, F.col("sales_next_month").cast("double").alias("sales"), F.col("revenue_next_month").alias("revenue"))


@query
def ground_truth(spark, d, s=STAR):
    return _truth(spark, d, s)


@query
def evaluate_sales(spark, d, s=STAR):
    return s.rounded(E.evaluate(_truth(spark, d, s), _baseline(spark, d, s)).select("mae_sales", "mape_sales"))


@query
def evaluate_revenue(spark, d, s=STAR):
    return s.rounded(E.evaluate(_truth(spark, d, s), _baseline(spark, d, s)).select("mae_revenue", "mape_revenue"), 4)


@query
def score_active_universe(spark, d, s=STAR):
    y, r, p = F.col("y_true"), F.col("revenue_true"), F.col("pred_base")
    earned = p * F.coalesce("price", F.lit(0.0))
    return s.rounded(_scored(spark, d, s).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(y > 0).alias("n_positive"), E.mae(y, p).alias("mae_quantity"), E.mape(y, p).alias("mape_quantity"), E.mae(r, earned).alias("mae_revenue"), E.mape(r, earned).alias("mape_revenue")), 4)


@query
def validation_predictions(spark, d, s=STAR):
    return s.rounded(_scored(spark, d, s).select(*PAIR, "y_true", "pred_raw", "pred_log", "pred_base"))


@query
def group_metrics(spark, d, s=STAR):
    return s.rounded(E.group_metrics(_scored(spark, d, s), "pred_base"), 4)


@query
def distribution_metrics(spark, d, s=STAR):
    return s.rounded(_scored(spark, d, s).agg(*E.distribution(F.col("pred_base"))), 4)


@query
def validation_table(spark, d, s=STAR):
    rows = E.long_predictions(_scored(spark, d, s).select(*PAIR, "y_true", "pred_raw", "pred_log", "pred_base"), ["pred_raw", "pred_log", "pred_base"])
    y, p = F.col("y_true"), F.col("prediction")
    return s.rounded(rows.groupBy("model").agg(E.mae(y, p).alias("mae_quantity"), E.mape(y, p).alias("mape_quantity")).orderBy("mape_quantity"), 4)


def _kept(spark, d, s, cube=None):
    return M.with_status(_cube(spark, d, s) if cube is None else cube, s.items(spark, d))


@query
def q99_caps(spark, d, s=STAR):
    caps = G.quantile_caps(_kept(spark, d, s), s.target - 1)
    item = caps["item"].select(F.lit("item").alias("grain"), F.col("item_id").alias("key"), F.col("cap_item").alias("cap"), F.col("n_item").alias("n"))
    place = caps["location"].select(F.lit("location").alias("grain"), F.col("location").cast("string").alias("key"), F.col("cap_location").alias("cap"), F.col("n_location").alias("n"))
    whole = caps["global"].select(F.lit("global").alias("grain"), F.lit("").alias("key"), F.col("cap_global").alias("cap"), F.lit(0).cast("bigint").alias("n"))
    return s.rounded(item.unionByName(place).unionByName(whole))


def _capped_rows(spark, d, s=STAR):
    cube = _settled_cube(spark, d, s)
    return G.with_caps(_scored(spark, d, s, cube), G.quantile_caps(_kept(spark, d, s, cube), s.target - 1))


@query
def apply_caps(spark, d, s=STAR):
    rows = _capped_rows(spark, d, s)
    return s.rounded(rows.select(*PAIR, *(G.capped(F.col("pred_base"), G.cap_of(F.lit(k)), F.lit(1.25)).alias(f"capped_{k}") for k in G.KINDS)))


@query
def safe_postprocess(spark, d, s=STAR):
    top = G.quantile_caps(_kept(spark, d, s), s.target - 1)["global"].scalar()
    return s.rounded(G.safe_caps(_capped_rows(spark, d, s), "pred_base", top).select("postprocess", "mae_quantity", "mape_quantity"), 4)


@query
def alpha_scale_grid(spark, d, s=STAR):
    return s.rounded(G.alpha_scale(_scored(spark, d, s), "pred_raw", "pred_base").select("ordinal", "alpha", "scale", "mae_quantity", "mape_quantity"), 4)


@query
def alpha_scale_best(spark, d, s=STAR):
    table = s.rounded(G.alpha_scale(_scored(spark, d, s), "pred_raw", "pred_base"), 4)
    return G.best(table, "mape_quantity", "ordinal").select("alpha", "scale", "mape_quantity")


@query
def postprocess_grid(spark, d, s=STAR):
    return s.rounded(G.cap_floor_grid(_capped_rows(spark, d, s), "pred_base").select("clip_kind", "clip_mult", "floor", "mae_quantity", "mape_quantity"), 4)


@query
def global_scale_sweep(spark, d, s=STAR):
    return s.rounded(G.scale_sweep(_scored(spark, d, s), "pred_base").select("scale", "mae_quantity", "mape_quantity"), 4)


def _grouped(spark, d, s, refined=True):
    return settled(_scored(spark, d, s).withColumn("activity", E.activity_group(F.col("recent"), refined)))


@query
def group_scale_tuning(spark, d, s=STAR):
    rows = _grouped(spark, d, s)
    return s.rounded(G.group_scales(rows, "pred_base", "activity", E.ACTIVITY, G.best_scale(rows, "pred_base")), 4)


@query
def group_scale_tuning_three(spark, d, s=STAR):
    rows = _grouped(spark, d, s, False)
    return s.rounded(G.group_scales(rows, "pred_base", "activity", E.ACTIVITY_THREE, G.best_scale(rows, "pred_base")), 4)


@query
def apply_group_scales(spark, d, s=STAR):
    rows = _grouped(spark, d, s)
    scales = G.group_scales(rows, "pred_base", "activity", E.ACTIVITY, G.best_scale(rows, "pred_base"))
    predictions = rows.select(*PAIR, "activity", F.col("pred_base").alias("prediction"))
    return s.rounded(P.apply_scales(predictions, scales, "activity"))


@query
def mean_ensemble(spark, d, s=STAR):
    return s.rounded(_scored(spark, d, s).select(*PAIR, G.mean_of(["pred_raw", "pred_log", "pred_base"]).alias("prediction")))


@query
def blend_weight_grid(spark, d, s=STAR):
    table = G.weight_grid(_scored(spark, d, s), ["pred_raw", "pred_log", "pred_base"], 5)
    return s.rounded(table.select("ordinal", "w_pred_raw", "w_pred_log", "w_pred_base", "mape_quantity"), 4)


@query
def fixed_blends(spark, d, s=STAR):
    return s.rounded(_scored(spark, d, s).select(*PAIR, *(c.alias(n) for n, c in G.fixed_blends("pred_raw", "pred_log", "pred_base").items())))


def _candidates(spark, d, s):
    rows = _scored(spark, d, s).withColumn("pred_mid", (F.col("pred_raw") + F.col("pred_base")) / 2).withColumn("activity", E.activity_group(F.col("recent")))
    return G.scale_candidates(rows, {"none": "pred_raw", "inv_y": "pred_base", "inv_sqrt_y": "pred_mid"}, "pred_log", "pred_base", "activity", E.ACTIVITY)


@query
def candidate_table(spark, d, s=STAR):
    table, _ = _candidates(spark, d, s)
    return s.rounded(table, 4)


@query
def candidate_group_scales(spark, d, s=STAR):
    _, scales = _candidates(spark, d, s)
    return s.rounded(scales, 4)


@query
def extra_candidates(spark, d, s=STAR):
    table, _ = _candidates(spark, d, s)
    return s.rounded(G.extra_choices(table), 4)


def _final(spark, d, s):
    """Predictions of the month after the target, over the history with it: raw, log (stand-ins for models), weighted baseline."""
    frame = _frame(spark, d, s, [s.target + 1], cube=_cube(spark, d, s), label=False, codes=False, blocks=("item", "location"))
    return frame.select(*PAIR, F.col("baseline_rolling3").alias("pred_raw"), F.col("baseline_lag1").alias("pred_log"), F.col("baseline_weighted").alias("pred_base"))


@query
def tuned_final(spark, d, s=STAR):
    """Caps and floor tuned on the target month, applied to the next one with caps of all months by then."""
    cube = _settled_cube(spark, d, s)
    kept = settled(_kept(spark, d, s, cube))
    rows = G.with_caps(_scored(spark, d, s, cube), G.quantile_caps(kept, s.target - 1))
    tuned = G.best(G.cap_floor_grid(rows, "pred_base").withColumn("mape_quantity", F.round("mape_quantity", 6)), "mape_quantity", "ordinal")
    final = G.with_caps(_final(spark, d, s), G.quantile_caps(kept, s.target))
    return s.rounded(G.apply_tuned(final, "pred_base", tuned))


@query
def final_blend(spark, d, s=STAR):
    """Blend weights tuned on the target month, applied to the next one with a baseline as of the target month's end."""
    models = ["pred_raw", "pred_log", "pred_base"]
    grid = G.weight_grid(_scored(spark, d, s), models, 5).withColumn("mape_quantity", F.round("mape_quantity", 6))
    base = B.zero_where_status(B.baseline(s.sales(spark, d).where(F.col("sale_date") <= F.lit(s.last_day)), s.last_day), s.items(spark, d))
    final = _final(spark, d, s).drop("pred_base").join(base.withColumnRenamed("prediction", "pred_base"), PAIR, "left")
    return s.rounded(G.apply_weights(final, G.best(grid, "mape_quantity", "ordinal"), models).select(*PAIR, "prediction"))


@query
def monthly_cap_90d(spark, d, s=STAR):
    return P.daily_caps(_past(spark, d, s), s.cutoff)


@query
def floor_and_refill(spark, d, s=STAR):
    rates = W.engagement_ratios(_trailing(spark, d, s).select(*PAIR, "sales_sum_28d").join(W.engagement_windows(s.engagement(spark, d), s.cutoff), "item_id"))
    floored = P.floor_predictions(_baseline(spark, d, s), 30.0)
    return s.rounded(P.refill_from_carts(floored, rates))


@query
def classic_postprocess(spark, d, s=STAR):
    rates = W.engagement_ratios(_trailing(spark, d, s).select(*PAIR, "sales_sum_28d").join(W.engagement_windows(s.engagement(spark, d), s.cutoff), "item_id"))
    out = P.cap_predictions(_baseline(spark, d, s), P.daily_caps(_past(spark, d, s), s.cutoff, multiplier=0.05))
    out = P.refill_from_carts(P.floor_predictions(out), rates)
    return s.rounded(B.zero_where_status(out, s.items(spark, d)))


def _training(spark, d, s=STAR):
    return settled(_frame(spark, d, s, s.targets, codes=False, blocks=()).select(*PAIR, "t", "target", "li_qty_lag1", "li_qty_roll_mean_3"))


@query
def sample_positive_first(spark, d, s=STAR):
    return S.positive_first(_training(spark, d, s), 3000, [*PAIR, "t"])


@query
def sample_negative_ratio(spark, d, s=STAR):
    return S.negative_ratio(_training(spark, d, s), 0.5, [*PAIR, "t"])


@query
def sample_counts(spark, d, s=STAR):
    rows = S.negative_ratio(_training(spark, d, s), 0.5, [*PAIR, "t"])
    return rows.agg(F.count_if(F.col("target") > 0).alias("positives"), F.count_if(F.col("target") <= 0).alias("zeros"))


@query
def sample_weights(spark, d, s=STAR):
    y = F.col("target")
    return s.rounded(_training(spark, d, s).select(*PAIR, "t", S.row_weight(y, "inv_y", 0.3).alias("inv_y"), S.row_weight(y, "inv_sqrt_y", 0.3).alias("inv_sqrt_y")))


@query
def sampling_diagnostic(spark, d, s=STAR):
    return s.rounded(S.diagnostic(_training(spark, d, s)))


@query
def sample_month_counts(spark, d, s=STAR):
    rows = S.sample_months(_training(spark, d, s), 4995, "t", [*PAIR, "t"], ratio=0.5)
    return rows.groupBy("t").agg(F.count_if(F.col("target") > 0).alias("positives"), F.count_if(F.col("target") <= 0).alias("zeros"))


@query
def sample_month_budget(spark, d, s=STAR):
    return S.sample_months(_training(spark, d, s), 4995, "t", [*PAIR, "t"])


@query
def sample_checks(spark, d, s=STAR):
    """What holds of each sample: rows, positives, rows not of the frame, keys that come twice."""
    rows = _training(spark, d, s)
    keys = [*PAIR, "t"]
    samples = {"positive_first": S.positive_first(rows, 3000, keys), "negative_ratio": S.negative_ratio(rows, 0.5, keys), "month_budget": S.sample_months(rows, 4995, "t", keys)}
    parts = []
    for name, got in samples.items():
        counts = got.groupBy(*keys, "target").agg(F.count(F.lit(1)).alias("n")).join(rows.select(*keys, "target", F.lit(True).alias("known")), [*keys, "target"], "left")
        parts.append(counts.agg(F.lit(name).alias("sample"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("target") > 0, F.col("n"))), F.lit(0)).alias("positives"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("twice")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def data_audit_profile(spark, d, s=STAR):
    sales = s.sales(spark, d).select("location", "item_id", "sale_date", F.col("quantity").cast("bigint").alias("quantity"))
    return Q.profile(sales)


@query
def monthly_summary(spark, d, s=STAR):
    return Q.month_summary(s.sales(spark, d))


@query
def event_type_counts(spark, d, s=STAR):
    return Q.value_counts(s.engagement(spark, d), "event_type")


@query
def submission_check(spark, d, s=STAR):
    return Q.check_output(_baseline(spark, d, s), s.items(spark, d))


@query
def duplicate_keys(spark, d, s=STAR):
    return Q.repeated_keys(s.sales(spark, d), ["location", "item_id", "sale_date"])


@query
def top_predictions(spark, d, s=STAR):
    return s.rounded(_baseline(spark, d, s)).orderBy(F.col("prediction").desc(), "location", "item_id").limit(10)


@query
def prediction_variants(spark, d, s=STAR):
    return s.rounded(G.prediction_variants(_scored(spark, d, s), "pred_base", 0.9, control="pred_log"))


@query
def compare_runs(spark, d, s=STAR):
    return s.rounded(G.compare_runs(_scored(spark, d, s), ["pred_raw", "pred_log", "pred_base"]), 4)


@query
def submission_statistics(spark, d, s=STAR):
    return s.rounded(_baseline(spark, d, s).agg(*E.output_statistics(F.col("prediction"))))


@query
def floored_count(spark, d, s=STAR):
    return P.count_floored(_baseline(spark, d, s), 30.0)


@query
def universe_summary(spark, d, s=STAR):
    return E.universe_summary(_cube(spark, d, s), s.items(spark, d), s.target + 1)


@query
def check_candidates(spark, d, s=STAR):
    base = _baseline(spark, d, s)
    outputs = {"base": base, "scaled": base.withColumn("prediction", F.col("prediction") * -0.5), "absent_group": None, "absent": None}
    return Q.check_many(outputs, {"absent_group": "base"}, s.items(spark, d))


@query
def normalised_output(spark, d, s=STAR):
    old = _baseline(spark, d, s).select(F.lit(0).alias("Unnamed: 0"), F.col("location").cast("string").alias("location"), "item_id", (F.col("prediction") - 20).cast("string").alias("quantity_pred"))
    return s.rounded(Q.normalise_output(old))


@query
def output_frame(spark, d, s=STAR):
    return s.rounded(K.output_frame(_baseline(spark, d, s)))


def _models(spark, d, s=STAR):
    """Feature frames for training (all earlier targets) and scoring (the last), written once, and all their features."""
    frame = settled(_frame(spark, d, s, s.targets))
    return frame.where(F.col("t") < s.target), frame.where(F.col("t") == s.target), MO.feature_names(frame)


@query
def gbt_raw(spark, d, s=STAR):
    train, score, names = _models(spark, d, s)
    return MO.predict(MO.fit_raw(train, names), score, names)


@query
def gbt_log(spark, d, s=STAR):
    train, score, names = _models(spark, d, s)
    return MO.predict(MO.fit_raw(train, names, log=True), score, names, log=True)


@query
def two_stage(spark, d, s=STAR):
    train, score, names = _models(spark, d, s)
    return MO.two_stage(train, score, names)


@query
def feature_importance(spark, d, s=STAR):
    train, _, names = _models(spark, d, s)
    return MO.importance(spark, MO.fit_raw(train, names), names)


@query
def linear_models(spark, d, s=STAR):
    """Poisson and Tweedie models of the pair's own recent sales."""
    train, score, _ = _models(spark, d, s)
    names = ["li_qty_lag1", "li_qty_roll_mean_3", "li_qty_roll_mean_6", "month_sin", "month_cos"]
    parts = [MO.predict(MO.fit_linear(train, names, family), score, names).withColumn("family", F.lit(family)) for family in ("poisson", "tweedie")]
    return parts[0].unionByName(parts[1])


@query
def weighted_models_final(spark, d, s=STAR):
    """One model per weight mode, stopped early on the last target, fitted again on all of them with the rounds it took,
    written, read back, and its predictions of the next month."""
    frame = settled(_frame(spark, d, s, [*s.targets, s.target + 1], cube=_cube(spark, d, s)))
    train, valid, score = frame.where(F.col("t") < s.target), frame.where(F.col("t") == s.target), frame.where(F.col("t") > s.target)
    return MO.weighted_finals(train, valid, score, MO.feature_names(frame), scratch_path(spark))


#: Queries that also run over the purchase, event and item tables, as name_2025.
OVER_PURCHASES = (
    "sales_view items_view engagement_view rolling_sum_windows rolling_std_daily last_price item_features location_features category_share engagement_counts engagement_rates classic_features last_month_baseline rolling_baseline "
    "baseline_submission purchase_monthly event_monthly label_codes lag_features roll3_stats event_extras weighted_baseline monthly_features training_frames_multi_target ground_truth score_active_universe group_metrics validation_predictions q99_caps apply_caps "
    "alpha_scale_grid group_scale_tuning candidate_table tuned_final final_blend classic_postprocess monthly_summary sampling_diagnostic universe_summary submission_statistics"
).split()
for _name in OVER_PURCHASES:
    QUERIES[f"{_name}_2025"] = lambda spark, d, f=QUERIES[_name]: f(spark, d, PURCHASES)
    SQL[f"{_name}_2025"] = over_purchases(SQL[_name])
