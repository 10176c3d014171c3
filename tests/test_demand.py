"""Hand-computed fixtures of the demand engine and its invariants."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import baselines as B
from tallyforge.operators import cubes as C
from tallyforge.operators import monthly as M
from tallyforge.operators import postprocess as P
from tallyforge.operators import quality as Q
from tallyforge.operators import sampling as S
from tallyforge.operators import scoring as E
from tallyforge.operators import tuning as G
from tallyforge.operators import windows as W
from tallyforge.sources import views

D = datetime.date
PAIR = ["location", "item_id"]
SALES = "location int, item_id string, sale_date date, quantity decimal(18,0), price decimal(18,2)"


def sales(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(l, i, d, Decimal(q), None if p is None else Decimal(p)) for l, i, d, q, p in rows], SALES)


def month(n):
    return 2025 * 12 + n


def test_month_series(spark):
    cube = spark.createDataFrame([(1, "a", month(m), q, 0.0) for m, q in ((1, 5), (3, 7), (4, 1))], "location int, item_id string, m int, qty bigint, rev double")
    r = M.series_features(cube, PAIR, {"x": ("qty", True)}, [month(5)], month(1)).first()
    want = {"lag1": 1, "lag2": 7, "lag3": 0, "lag6": 0, "roll_mean_3": 8 / 3, "roll_mean_6": 13 / 6, "roll_median_3": 1, "roll_std_3": 3.091206, "roll_max_3": 7, "roll_min_3": 0, "months_since_last_sale": 0, "number_of_sale_months": 3, "zero_sale_months": 1, "trend_3": 1, "growth_ratio": 0.125, "lag1_to_roll3": 1 / (8 / 3 + 1)}
    assert all(math.isclose(r[f"x_{k}"], v, abs_tol=1e-6) for k, v in want.items())


def test_many_targets_equal_single_ones(spark):
    cube = spark.createDataFrame([(1, "a", month(m), m * m % 7, 1.0) for m in (1, 2, 4, 5, 8)] + [(2, "b", month(3), 4, 1.0)], "location int, item_id string, m int, qty bigint, rev double")
    series = {"x": ("qty", True)}
    many = {(r.location, r.t): r for r in M.series_features(cube, PAIR, series, [month(5), month(9)], month(1)).collect()}
    for t in (5, 9):
        for r in M.series_features(cube, PAIR, series, [month(t)], month(1)).collect():
            assert many.pop((r.location, r.t)) == r
    assert not many


def test_trailing_days(spark):
    df = sales(spark, [(1, "a", D(2025, 1, 3), 2, "10"), (1, "a", D(2025, 1, 4), 3, "10"), (1, "a", D(2025, 1, 31), 1, "12"), (1, "a", D(2025, 1, 31), 4, None), (1, "a", D(2025, 2, 1), 99, "1")])
    r = W.trailing(W.day_totals(df, PAIR), PAIR, D(2025, 1, 31)).first()
    assert (r.sales_sum_7d, r.sales_sum_28d, r.days_since_last_sale, r.sales_nonzero_days_28d) == (5, 8, 0, 2)
    assert math.isclose(r.sales_mean_28d, 0.285714, abs_tol=1e-6) and math.isclose(r.sales_std_28d, 1.414214, abs_tol=1e-6)
    assert r.revenue_sum_7d == 12 and W.last_positive_price(df.where("sale_date <= '2025-01-31'"), PAIR).first().last_price == 12


def test_no_leakage(spark):
    rows = [(1 + i % 3, "ab"[i % 2], D(2025, 1, 1) + datetime.timedelta(days=i * 3), 1 + i % 4, "5") for i in range(60)]
    items = spark.createDataFrame([("a", "c1", "b1", 1), ("b", None, "b2", 0)], "item_id string, category string, brand string, sale_status int")
    seen = spark.createDataFrame([("a", D(2025, 3, 1), "view_item", 1)], "item_id string, event_date date, event_type string, quantity int")
    cut = D(2025, 3, 31)
    whole, past = (W.classic_frame(sales(spark, x), items, seen, cut, None).orderBy(*PAIR).collect() for x in (rows, [r for r in rows if r[2] <= cut]))
    assert whole == past and len(whole) == 6


def test_metrics(spark):
    df = spark.createDataFrame([(2.0, 1.0), (0.0, 3.0), (4.0, 5.0)], "y double, p double")
    y, p = F.col("y"), F.col("p")
    assert df.agg(E.mae(y, p), E.mape(y, p)).first()[:] == pytest.approx((1.666667, 37.5), abs=1e-6)
    more = df.union(spark.createDataFrame([(2.0, 0.0)], "y double, p double"))
    assert more.agg(E.mae(y, p), E.mape(y, p)).first()[:] == pytest.approx((1.75, 58.333333), abs=1e-6)
    assert df.where("y = 0").agg(E.mape(y, p)).first()[0] is None


def test_universe_counts_cold_pairs(spark):
    cube = spark.createDataFrame([(1, "a", month(11), 3, 0.0), (1, "new", month(12), 2, 0.0), (2, "a", month(11), 9, 0.0)], "location int, item_id string, m int, qty bigint, rev double")
    rows = E.evaluation_rows(cube, spark.createDataFrame([(1, "a", -1.0)], "location int, item_id string, p double"), month(12), ["p"]).orderBy("item_id").collect()
    assert [(r.location, r.item_id, r.y_true, r.p) for r in rows] == [(1, "a", 0.0, 0.0), (1, "new", 2.0, 0.0)]


def test_quantile_is_linear(spark):
    cube = spark.createDataFrame([(1, "a", month(m + 1), q) for m, q in enumerate((1, 2, 5, 9, 20, 21))], "location int, item_id string, m int, qty bigint")
    assert G.quantile_caps(cube, month(6))["item"].first().cap_item == pytest.approx(20.95)


@pytest.mark.parametrize("rows,want", [([("last", 0), ("r90", 6)], 0.0), ([("r90", 6)], 6 * 31 / 90), ([], 1.5)])
def test_fallbacks(spark, rows, want):
    cut = D(2025, 11, 30)
    data = [(1, "x", D(2024, 1, 1), 5, "1"), (2, "x", D(2025, 11, 1), 1, "1"), (2, "x", D(2025, 11, 2), 2, "1")]
    data += [(1, "x", D(2025, 11, 5), q, "1") if k == "last" else (1, "x", D(2025, 9, 10), q, "1") for k, q in rows]
    got = {r.location: r.prediction for r in B.baseline(sales(spark, data), cut).collect()}
    assert got[1] == pytest.approx(want if rows else 1.5)


def test_events_by_month(spark):
    from decimal import Decimal

    rows = [("A", D(2024, 6, 10), "view_item", Decimal(2)), ("A", D(2025, 6, 11), "view_item", Decimal(3)), ("A", D(2025, 6, 12), "add_to_cart", Decimal(1))]
    df = spark.createDataFrame(rows, "item_id string, event_date date, event_type string, quantity decimal(18,0)")
    plain = C.engagement_months(df, month(1), month(12)).first()
    folded = C.engagement_months(df, month(1), month(12), fold_years=True).first()
    assert (plain.view_count, plain.view_qty, plain.atc_count) == (1, 3, 1) and (folded.view_count, folded.view_qty) == (2, 5)


def test_postprocess_order(spark):
    pred = spark.createDataFrame([(1, "a", 0.4), (1, "z", 0.4)], "location int, item_id string, prediction double")
    carts = spark.createDataFrame([("a", 7, 0.5), ("z", 7, 0.5)], "item_id string, atc_count_7d bigint, atc_to_purchase_rate_28d double")
    items = spark.createDataFrame([("z", 0)], "item_id string, sale_status int")
    out = B.zero_where_status(P.refill_from_carts(P.floor_predictions(pred), carts), items)
    assert {r.item_id: r.prediction for r in out.collect()} == pytest.approx({"a": 15.5, "z": 0.0})


def test_caps(spark):
    pred = spark.createDataFrame([(1, "a", 100.0), (1, "b", 100.0), (1, "c", None)], "location int, item_id string, prediction double")
    caps = spark.createDataFrame([(1, "a", 62.0)], "location int, item_id string, max_monthly_cap double")
    assert {r.item_id: r.prediction for r in P.cap_predictions(pred, caps).collect()} == {"a": 62.0, "b": 100.0, "c": 0.0}
    df = spark.createDataFrame([(5.0, None), (5.0, 0.0), (5.0, 2.0)], "p double, c double")
    assert [r[0] for r in df.select(G.capped(F.col("p"), F.col("c"), F.lit(1.5))).collect()] == [5.0, 5.0, 3.0]


def test_groups(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 0.50001, 1.0, 5.0, 20.0, 20.1)], "x double")
    assert [r[0] for r in df.select(E.activity_group(F.col("x"))).collect()] == ["very_low", "low", "low", "mid", "high", "very_high"]


def test_status(spark):
    cube = spark.createDataFrame([(1, i, month(1), 1, 1.0) for i in "ABCD"], "location int, item_id string, m int, qty bigint, rev double")
    items = spark.createDataFrame([("A", "c", "b", None), ("B", "c", "b", 1), ("C", "c", "b", 0)], "item_id string, category string, brand string, sale_status int")
    assert sorted(r.item_id for r in M.with_status(cube, items).collect()) == ["B", "D"]


def test_grid_is_one_pass_and_equals_loop(spark):
    rows = [(float(i % 4), float(i % 5), float(i % 3) + 0.5) for i in range(50)]
    df = spark.createDataFrame(rows, "y_true double, a double, b double")
    table = {(r.alpha, r.scale): (r.mae_quantity, r.mape_quantity) for r in G.alpha_scale(df, "a", "b").collect()}
    assert len(table) == 252
    for (al, sc), got in list(table.items())[::17]:
        e = [(y, max(0.0, (al * a + (1 - al) * b) * sc)) for y, a, b in rows]
        want = (sum(abs(y - p) for y, p in e) / len(e), 100 * sum(abs(y - p) / y for y, p in e if y > 0) / sum(y > 0 for y, _ in e))
        assert got == pytest.approx(want)


def test_group_scales_never_worse(spark):
    rows = [("g1" if i % 2 else "g2", float(1 + i % 6), float(1 + i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, y_true double, p double")
    whole = G.best(G.scale_sweep(df, "p"), "mape_quantity", "scale").first()
    scales = {r.g: r.group_scale for r in G.group_scales(df, "p", "g", ["g1", "g2", "empty"], whole.scale).collect()}
    assert scales["empty"] == whole.scale
    err = lambda s: sum(abs(y - p * s(g)) / y for g, y, p in rows)
    assert err(lambda g: scales[g]) <= err(lambda g: whole.scale) + 1e-9


@pytest.mark.parametrize("max_rows,want", [(8, (6, 2)), (4, (4, 0)), (0, (6, 10)), (99, (6, 10))])
def test_positive_first(spark, max_rows, want):
    df = spark.createDataFrame([(i, float(i < 6)) for i in range(16)], "k int, target double")
    rows = S.positive_first(df, max_rows, ["k"]).collect()
    assert (sum(r.target > 0 for r in rows), sum(r.target <= 0 for r in rows)) == want and len({r.k for r in rows}) == len(rows)
    assert sorted(r.k for r in S.positive_first(df, max_rows, ["k"]).collect()) == sorted(r.k for r in rows)


def test_ratio_counts():
    assert S.ratio_counts(6, 10, 0.5) == (6, 3) and S.ratio_counts(6, 10, 1.0, 8) == (4, 4) and S.ratio_counts(0, 10, 1.0, 4) == (0, 4) and S.ratio_counts(6, 0, 1.0, 3) == (3, 0)


def test_ratio_counts_rules():
    """Under any cap: never more than there are, never beyond the cap, and without a cap all positives."""
    for p in range(7):
        for z in range(7):
            for ratio in (0, 0.5, 1.0, 3.3):
                for cap in (0, 1, 2, 5, 30):
                    a, b = S.ratio_counts(p, z, ratio, cap)
                    assert 0 <= a <= p and 0 <= b <= z and (cap == 0 or a + b <= cap) and (a + b > 0 or p + z == 0 or (p == 0 and z == 0))
                    if cap in (0, 30) and p:
                        assert (a, b) == (p, min(z, math.ceil(p * ratio)))
    assert S.ratio_counts(100, 1000, 1.0, 11) == (6, 5) and S.ratio_counts(100, 1000, 4.0, 10) == (2, 8) and S.ratio_counts(5, 5, 0.0, 3) == (3, 0)


def test_lowest_hashes_by_stratum(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("g"), F.lit(0).alias("__b"))
    got = S.take_lowest_by(df, F.col("g"), {"0": 10, "1": 5000, "2": 0, "x": 4}, ["k"], 7)
    rows = got.collect()
    assert got.columns == df.columns and [sum(r.g == g for r in rows) for g in "012"] == [10, 1000, 0] and len({r.k for r in rows}) == 1010
    hashes = sorted((r.h % (1 << 64), r.k) for r in df.where("g = '0'").select("k", S.hash_order(["k"], 7).alias("h")).collect())
    assert {r.k for r in rows if r.g == "0"} == {k for _, k in hashes[:10]} and {r["__b"] for r in rows} == {0}


@pytest.mark.parametrize("ratio,want", [(None, {1: (20, 10), 2: (4, 26), 3: (0, 30)}), (0.5, {1: (20, 10), 2: (4, 2), 3: (0, 30)})])
def test_month_budgets(spark, ratio, want):
    rows = [(m, i, 1.0 if i < n else 0.0) for m, n in ((1, 20), (2, 4), (3, 0)) for i in range(100)] + [(None, 1, 1.0), (1, 100, None)]
    df = spark.createDataFrame(rows, "t int, k int, target double")
    got = S.sample_months(df, 90, "t", ["k", "t"], ratio=ratio)
    counts = {m: (p, n - p) for m, n, p in got.groupBy("t").agg(F.count(F.lit(1)), F.count_if(F.col("target") > 0)).collect()}
    assert counts == want
    assert S.sample_months(df, 50, "t", ["k", "t"], ratio=ratio).count() <= 50 and S.sample_months(df.limit(0), 50, "t", ["k", "t"]).count() == 0
    assert S.sample(df, ["k", "t"]).count() == 302 and S.sample(df, ["k", "t"], ratio=-1.0).count() == 302


def test_weights(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (4.0,)], "y double")
    y = F.col("y")
    assert [tuple(r) for r in df.select(S.row_weight(y, "none"), S.row_weight(y, "inv_y", 0.3), S.row_weight(y, "inv_sqrt_y", 0.3)).collect()] == [(1.0, 0.3, 0.3), (1.0, 1.0, 1.0), (1.0, 0.25, 0.5)]


def test_codes_are_in_string_order(spark):
    values = [str(i) for i in range(2000)] + ["a", "é", ""]
    df = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], "v string")
    got = {r.v: r.c for r in C.dictionary_codes(df, "v", "c").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values, key=lambda v: v.encode()))}


def test_codes_of_several_fields(spark):
    rows = [("a", v) for v in ("x", "SKU-2", "SKU-10", "SKU-1", "x", None)] + [("b", v) for v in ("z", "y")]
    got = {(r.field, r.value): r.code for r in C.value_codes(spark.createDataFrame(rows, "field string, value string")).collect()}
    assert got == {("a", "SKU-1"): 0, ("a", "SKU-10"): 1, ("a", "SKU-2"): 2, ("a", "x"): 3, ("b", "y"): 0, ("b", "z"): 1}


def test_grains_add_up(spark):
    df = sales(spark, [(1 + i % 4, "abcde"[i % 5], D(2025, 1 + i % 6, 3), 1 + i % 3, "2.50") for i in range(90)])
    items = spark.createDataFrame([("a", "c1", "b1"), ("b", "c1", "b2"), ("c", "c2", "b1")], "item_id string, category string, brand string")
    cube = C.sales_months(df, month(1), month(6))
    sums = {(r.grain, r.m): (r.q, r.r) for r in C.all_grains(cube, items).groupBy("grain", "m").agg(F.sum("qty").alias("q"), F.sum("rev").alias("r")).collect()}
    for m in range(1, 7):
        assert len({sums[(g, month(m))] for g in ("pair", "item", "location", "category", "brand")}) == 1


def test_returns_give_defined_ratios(spark):
    """A month with a total of -1 makes a denominator 0: the ratio is 0, not an error."""
    cube = spark.createDataFrame([(1, "a", month(3), -1), (1, "a", month(4), 5)], "location int, item_id string, m int, qty bigint")
    r = M.series_features(cube, PAIR, {"x": ("qty", True)}, [month(5)], month(1)).first()
    assert (r.x_lag1, r.x_lag2, r.x_growth_ratio) == (5.0, -1.0, 0.0)


def test_location_events_have_their_own_block(spark):
    from dataclasses import replace as changed

    cube = spark.createDataFrame([(1, "a", month(1), 2, 1.0), (2, "a", month(2), 3, 1.0)], "location int, item_id string, m int, qty bigint, rev double")
    items = spark.createDataFrame([("a", "c", "b", 1)], "item_id string, category string, brand string, sale_status int")
    events = spark.createDataFrame([(1, "a", month(2), 7, 4), (9, "a", month(2), 5, 0)], "location int, item_id string, m int, view_count bigint, atc_count bigint")
    frame = M.monthly_frame(cube, events, items, [month(3)], month(1), label=False, config=changed(M.DEFAULTS, event_features=True))
    got = {r.location: (r.view_item_lag1, r.li_view_lag1, r.li_atc_lag1, round(r.li_atc_per_view, 6)) for r in frame.collect()}
    assert got == {1: (12.0, 7.0, 4.0, round((4 / 3) / (7 / 3 + 1), 6)), 2: (12.0, 0.0, 0.0, 0.0)}


def test_last_whole_month():
    assert B.last_month(D(2025, 11, 30)) == (D(2025, 11, 1), D(2025, 12, 1)) and B.last_month(D(2025, 11, 29)) == (D(2025, 10, 1), D(2025, 11, 1)) and B.last_month(D(2025, 12, 31)) == (D(2025, 12, 1), D(2026, 1, 1))


def test_years_do_not_fold(spark):
    df = sales(spark, [(1, "a", D(2024, 11, 5), 50, "1"), (1, "a", D(2025, 11, 5), 3, "1")])
    assert B.month_total(df, D(2025, 11, 30)).first().pred_lastmonth == 3.0
    assert B.baseline(df, D(2025, 11, 30)).first().prediction == 3.0


def test_empty_groups_have_rows(spark):
    df = spark.createDataFrame([(0.0, 1.0), (9.0, 8.0)], "y_true double, p double")
    got = {r.target_group: (r.n_pairs, r.mae_quantity, r.mape_quantity) for r in E.group_metrics(df, "p").collect()}
    assert got["y=0"] == (1, 1.0, None) and got["1<y<=5"] == (0, None, None) and got["y>5"] == (1, 1.0, pytest.approx(100 / 9)) and len(got) == 4


def test_scales_ensemble_weights(spark):
    df = spark.createDataFrame([(1, "a", 2.0, None, "low"), (1, "b", 4.0, 8.0, "odd"), (1, "c", None, None, None)], "location int, item_id string, prediction double, q double, g string")
    scales = spark.createDataFrame([("low", 0.5)], "g string, group_scale double")
    assert {r.item_id: r.prediction for r in P.apply_scales(df, scales, "g").collect()} == {"a": 1.0, "b": 4.0, "c": 0.0}
    assert [r[0] for r in df.orderBy("item_id").select(G.mean_of(["prediction", "q"])).collect()] == [2.0, 6.0, None]
    weights = spark.createDataFrame([(0.25, 0.75)], "w_prediction double, w_q double")
    assert {r.item_id: r.prediction for r in G.apply_weights(df, weights, ["prediction", "q"]).collect()} == {"a": 0.5, "b": 7.0, "c": 0.0}
    assert P.count_floored(df, 3.0).first().n_floored == 1


def test_candidates_choose_and_degrade(spark):
    rows = [(float(1 + i % 5), float(1 + i % 5) * (2.0 if i % 2 else 0.8), 50.0, 1.0, "g1" if i % 2 else "g2") for i in range(40)]
    df = spark.createDataFrame(rows, "y_true double, raw double, lg double, base double, g string")
    table, scales = G.scale_candidates(df, {"inv_y": "raw"}, "lg", "base", "g", ["g1", "g2", "none"], [{"scale": s} for s in (0.5, 0.75, 1.0, 1.25)])
    got = {r.candidate: r for r in table.collect()}
    assert set(got) == {"raw_inv_y", "raw_inv_y_group", "inv_y_raw_log", "inv_y_raw_baseline_80_20", "inv_y_raw_baseline_70_30"}
    assert got["raw_inv_y_group"].beats_global and got["raw_inv_y_group"].mape_quantity == pytest.approx(0) and got["raw_inv_y_group"].scale is None
    assert got["inv_y_raw_log"].blend_mode == "raw_only" and got["inv_y_raw_log"].mape_quantity == got["raw_inv_y"].mape_quantity
    assert {r.group: r.group_scale for r in scales.collect()} == {"g1": 0.5, "g2": 1.25, "none": got["raw_inv_y"].scale}
    extra = {r.candidate: r.is_choice for r in G.extra_choices(table).collect()}
    assert extra == {"raw_inv_y_group": True, "inv_y_raw_baseline_80_20": False, "inv_y_raw_baseline_70_30": False}
    only = G.extra_choices(table.where("not candidate like '%baseline%'").withColumn("beats_global", F.lit(False)))
    assert [r.candidate for r in only.collect()] == ["raw_inv_y_group"]


def test_universe_and_statistics(spark):
    cube = spark.createDataFrame([(1, "A", month(1), 1), (1, "B", month(1), 2), (2, "C", month(1), 0), (2, "D", month(9), 5), (3, "E", month(1), 4)], "location int, item_id string, m int, qty bigint")
    items = spark.createDataFrame([("A", 0), ("B", 1), ("E", None)], "item_id string, sale_status int")
    assert tuple(E.universe_summary(cube, items, month(9)).first()) == (3, 1, 2, 1, 1)
    df = spark.createDataFrame([(0.0,), (2.0,), (4.0,)], "p double")
    assert tuple(df.agg(*E.output_statistics(F.col("p"))).first()) == (3, 0.0, 4.0, 2.0, 1, 2)


def test_many_outputs(spark):
    good = spark.createDataFrame([(1, "a", 1.0)], "location bigint, item_id string, prediction double")
    rows = Q.check_many({"x": good, "x_group": None, "y": None}, {"x_group": "x"}).collect()
    assert {(r.output, r.checked) for r in rows} == {("x", "x"), ("x_group", "x"), ("y", "")} and [r.n for r in rows if r.check == "missing"] == [1]
    assert Q.column_hints(["location", "item_id", "prediction"]) == []
    assert Q.column_hints(["Unnamed: 0", "location", "quantity"])[1:] == ["index column: Unnamed: 0", "rename quantity to prediction", "no column item_id"]


def test_new_year_rows():
    r = M.new_year_rows([2025 * 12 + 12, 2026 * 12 + 1, 2026 * 12 + 2, 2031 * 12 + 1])
    assert [x[1:] for x in r[:3]] == [(78.0, 1, 0, 0, 0, 0), (47.0, 1, 1, 1, 0, 0), (16.0, 1, 1, 1, 1, 1)]
    assert r[3][1] < 0


def test_output_contract(spark):
    df = spark.createDataFrame([(1, "a", -1.0), (1, "a", float("nan")), (2, None, 2.0), (3, "z", 5.0)], "location bigint, item_id string, prediction double")
    items = spark.createDataFrame([("z", 0)], "item_id string, sale_status int")
    got = {r.check: r.n for r in Q.check_output(df, items).collect()}
    assert got == {"columns": 0, "nulls": 1, "not_finite": 1, "negative": 1, "repeated_keys": 1, "status_zero_positive": 1}
    assert Q.check_output(df.select("item_id", "location", "prediction")).where("check = 'columns'").first().n == 1
    old = spark.createDataFrame([(0, "1", 7, "x"), (1, "1", 7, "2.5"), (2, "2", 7, "-3")], ["Unnamed: 0", "location", "item_id", "quantity"])
    assert sorted(map(tuple, Q.normalise_output(old).collect())) == [(1, "7", 0.0), (2, "7", 0.0)]  # the first row counts, unreadable as it is
    first = spark.createDataFrame([(1, "7", 2.0), (1, "7", 9.0), (1, "7", 1.0)], "location int, item_id string, prediction double").coalesce(1)
    assert [tuple(r) for r in Q.normalise_output(first).collect()] == [(1, "7", 2.0)]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "x int, y string")
    assert {r.column: (r.n_rows, r.n_nulls, r.n_distinct, r.least, r.greatest) for r in Q.profile(df).collect()} == {"x": (3, 0, 2, "1", "2"), "y": (3, 1, 2, "a", "b")}


def test_purchase_views(spark):
    d = "/root/testdata/sf0.001"
    from tallyforge.sources.tables import table

    s = views.purchase_sales(table(spark, d, "transaction_full_2025"))
    assert s.count() > 3000 and s.where("location < 0 or item_id is null").count() == 0
    i = views.purchase_items(table(spark, d, "items"))
    assert i.count() == i.select("item_id").distinct().count() > 100
    assert views.purchase_engagement(table(spark, d, "event_full_2025")).count() > 2000
    frame = M.monthly_frame(C.sales_months(s, month(1), month(12)), C.engagement_months(views.purchase_engagement(table(spark, d, "event_full_2025")), month(1), month(12)), i, [month(12)], month(1))
    assert frame.count() > 500 and len(frame.columns) > 137


def test_empty_tables(spark):
    none = sales(spark, [])
    items = spark.createDataFrame([], "item_id string, category string, brand string, sale_status int, item_price decimal(18,2)")
    seen = spark.createDataFrame([], "item_id string, event_date date, event_type string, quantity decimal(18,0)")
    cube = C.sales_months(none, month(1), month(12))
    assert W.classic_frame(none, items, seen, D(2025, 11, 30), D(2025, 12, 1)).count() == 0
    assert M.monthly_frame(cube, C.engagement_months(seen, month(1), month(12)), items, [month(12)], month(1)).count() == 0
    assert B.baseline(none, D(2025, 11, 30)).count() == 0
