"""Grid search as one aggregation: every candidate's errors come from a single pass over the scored rows.

A candidate is an entry of a literal list. Each row yields its error for all entries (explode inside the task),
sums are combined before the shuffle, and what is shuffled is a row per candidate and task, not per row."""

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.scoring import EPS, long_predictions, mae, mape, named, target_group
from tallyforge.sources.tables import settled

KINDS = ("none", "pair", "item", "location", "min_item_location")


def _literals(rows: list[dict]) -> Column:
    """The candidates as one array literal."""

    def text(v: int | float | str) -> str:
        return f"{v!r}D" if isinstance(v, float) else repr(v)

    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {text(v)}" for k, v in r.items()) + ")" for r in rows) + ")")


def grid_errors(rows: DataFrame, grid: list[dict], predict: Column, by: list[str] | None = None, y: str = "y_true") -> DataFrame:
    """A row per candidate (and group): its parameters, ordinal, mae_quantity, mape_quantity, ape_sum, n_positive.

    predict is an expression over rows' columns and the candidate's fields as columns; it is clipped at 0."""
    numbered = [{"ordinal": i} | g for i, g in enumerate(grid)]
    wide = rows.withColumn("__c", F.explode(_literals(numbered))).select("*", "__c.*")
    p, t = F.greatest(predict, F.lit(0.0)), F.col(y)
    ape = F.when(t > 0, F.abs(t - p) / F.greatest(t, F.lit(EPS)))
    names = list(numbered[0])
    sums = wide.groupBy(*(by or []), *names).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(t - p)).alias("__ae"), F.sum(ape).alias("ape_sum"), F.count(ape).alias("n_positive"))
    mape = F.when(F.col("n_positive") > 0, F.col("ape_sum") / F.col("n_positive") * 100)
    return sums.select(*(by or []), *names, (F.col("__ae") / F.col("n")).alias("mae_quantity"), mape.alias("mape_quantity"), "ape_sum", "n_positive")


def best(table: DataFrame, *order: str) -> DataFrame:
    """The first row by ascending order, nulls last; add the ordinal for "first wins"."""
    return table.orderBy(*(F.col(c).asc_nulls_last() for c in order)).limit(1)


def alpha_scale_grid(alphas: int = 21, low: float = 0.75, high: float = 1.30, step: float = 0.05) -> list[dict]:
    scales = [round(low + i * step, 4) for i in range(int(round((high - low) / step)) + 1)]
    return [{"alpha": a / (alphas - 1), "scale": s} for a in range(alphas) for s in scales]


def alpha_scale(rows: DataFrame, model: str, base: str, grid: list[dict] | None = None) -> DataFrame:
    mixed = F.col("alpha") * F.col(model) + (F.lit(1.0) - F.col("alpha")) * F.col(base)
    return grid_errors(rows, grid or alpha_scale_grid(), mixed * F.col("scale"))


def scale_values(low: float = 0.70, high: float = 1.15, step: float = 0.025) -> list[dict]:
    return [{"scale": round(low + i * step, 4)} for i in range(int(round((high - low) / step)) + 1)]


def scale_sweep(rows: DataFrame, prediction: str, grid: list[dict] | None = None) -> DataFrame:
    return grid_errors(rows, grid or scale_values(), F.col(prediction) * F.col("scale"))


def best_scale(rows: DataFrame, prediction: str, grid: list[dict] | None = None) -> Column:
    """The global scale of least relative, then absolute error, as a scalar subquery: the driver gets nothing."""
    return best(scale_sweep(rows, prediction, grid), "mape_quantity", "mae_quantity", "scale").select("scale").scalar()


def group_scales(rows: DataFrame, prediction: str, group: str, names: list[str], global_scale: float | Column, grid: list[dict] | None = None) -> DataFrame:
    """group, group_scale, group_mape: each group's scale with the least sum of relative errors (then the smaller one). The
    sum is separable, so one pass finds all. A group without positive truths gets the global scale."""
    errors = grid_errors(rows.where(F.col("y_true") > 0), grid or scale_values(), F.col(prediction) * F.col("scale"), by=[group])
    first = errors.groupBy(group).agg(F.min(F.struct("ape_sum", "scale", "mape_quantity")).alias("b"))
    other = global_scale if isinstance(global_scale, Column) else F.lit(global_scale)
    return named(first, group, names).select(group, F.coalesce("b.scale", other).alias("group_scale"), F.col("b.mape_quantity").alias("group_mape"))


def mean_of(models: list[str]) -> Column:
    """The mean of the models' predictions, as a row has them: nulls have no part; null if all are."""
    total = sum((F.coalesce(F.col(m), F.lit(0.0)) for m in models[1:]), F.coalesce(F.col(models[0]), F.lit(0.0)))
    n = sum((F.col(m).isNotNull().cast("int") for m in models[1:]), F.col(models[0]).isNotNull().cast("int"))
    return F.when(n > 0, total / n)


def simplex_weights(models: list[str], steps: int = 5) -> list[dict]:
    """All weight tuples of 0 to steps but the zero one, normalised to a sum of 1."""
    return [{f"w_{m}": c / sum(combo) for m, c in zip(models, combo)} for combo in product(range(steps + 1), repeat=len(models)) if sum(combo)]


def weight_grid(rows: DataFrame, models: list[str], steps: int = 5) -> DataFrame:
    total = None
    for m in models:
        one = F.col(m) * F.col(f"w_{m}")
        total = one if total is None else total + one
    return grid_errors(rows.where(F.col("y_true") > 0), simplex_weights(models, steps), total)


def quantile_caps(cube: DataFrame, last: int, q: float = 0.99) -> dict[str, DataFrame]:
    """Quantiles (linear between neighbours, exact) of month quantities by pair, item and location, with the
    number of pair months behind each, up to month last; and the global one."""
    hist = cube.where(F.col("m") <= last)
    quantile = F.percentile("qty", q)
    out = {"pair": hist.groupBy("location", "item_id").agg(quantile.alias("cap_pair"), F.count(F.lit(1)).alias("n_pair"))}
    for key in ("item", "location"):
        out[key] = hist.groupBy("item_id" if key == "item" else key).agg(quantile.alias(f"cap_{key}"), F.count(F.lit(1)).alias(f"n_{key}"))
    out["global"] = hist.agg(quantile.alias("cap_global"))
    return out


def with_caps(rows: DataFrame, caps: dict[str, DataFrame]) -> DataFrame:
    return rows.join(caps["pair"], ["location", "item_id"], "left").join(caps["item"], "item_id", "left").join(caps["location"], "location", "left")


def capped(prediction: Column, cap: Column, multiplier: Column) -> Column:
    """prediction, at most cap*multiplier; a cap that is null or not positive does not bind."""
    return F.when(cap > 0, F.least(prediction, cap * multiplier)).otherwise(prediction)


def cap_of(kind: Column) -> Column:
    c = F.col
    return F.when(kind == "pair", c("cap_pair")).when(kind == "item", c("cap_item")).when(kind == "location", c("cap_location")).when(
        kind == "min_item_location", F.when(c("cap_item").isNotNull() & c("cap_location").isNotNull(), F.least("cap_item", "cap_location")).otherwise(F.coalesce("cap_item", "cap_location"))
    )


def cap_grid() -> list[dict]:
    return [{"clip_kind": k, "clip_mult": m, "floor": f} for k in KINDS for m in (1.0, 1.25, 1.5, 2.0, 3.0) for f in (0.0, 0.1, 0.25, 0.5, 1.0)]


def cap_floor_grid(rows: DataFrame, prediction: str) -> DataFrame:
    """Errors of all cap kinds, multipliers and floors; rows have the caps."""
    cut = capped(F.col(prediction), cap_of(F.col("clip_kind")), F.col("clip_mult"))
    return grid_errors(rows, cap_grid(), F.when(cut < F.col("floor"), 0.0).otherwise(cut))


def safe_caps(rows: DataFrame, prediction: str, global_cap: float | Column | None, least: int = 3) -> DataFrame:
    """Errors of four cautious options: no cap, the global one, and item or location caps with enough months."""
    c, kind = F.col, F.col("postprocess")
    cap = F.when(kind == "global_q99", (global_cap if isinstance(global_cap, Column) else F.lit(global_cap)).cast("double")).when((kind == "item_q99") & (c("n_item") >= least), c("cap_item")).when((kind == "location_q99") & (c("n_location") >= least), c("cap_location"))
    return grid_errors(rows, [{"postprocess": n} for n in ("none", "global_q99", "item_q99", "location_q99")], capped(c(prediction), cap, F.lit(1.0)))


def fixed_blends(raw: str, log: str, base: str) -> dict[str, Column]:
    r, g, b = F.col(raw), F.col(log), F.col(base)
    return {"raw_only": r, "raw_log": r * 0.5 + g * 0.5, "raw_baseline_80_20": r * 0.8 + b * 0.2, "raw_baseline_70_30": r * 0.7 + b * 0.3}


#: Blends that count as an extra candidate in their own right.
EXTRA_BLENDS = ("raw_baseline_80_20", "raw_baseline_70_30")


def scale_candidates(rows: DataFrame, modes: dict[str, str], log: str, base: str, group: str, names: list[str], grid: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """The candidate table, and the group scales behind it.

    For each weight mode (its raw prediction's column): the raw prediction with the best global scale, with a scale for each
    group, and its three blends with a global scale. raw_log is the raw prediction itself where log is not better. Columns:
    candidate, weight_mode, blend_mode (as it came out), postprocess, scale (null for group scales), mape_quantity,
    mae_quantity, beats_global (null for global scales). The second table: weight_mode, group, group_scale, group_mape; a group
    without positive truths has the mode's global scale.

    Everything comes from one pass over rows: the error sums of each prediction, scale and group. What follows
    has a row per these."""
    columns = {("", "log"): F.col(log)}
    for mode, raw in modes.items():
        columns |= {(mode, "raw_only" if n == "raw_only" else n): c for n, c in fixed_blends(raw, log, base).items()}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("weight_mode"), F.lit(n).alias("blend"), c.alias("__p")) for (m, n), c in columns.items())))
    long = rows.select("y_true", F.col(group).alias("group"), each.alias("x")).select("y_true", "group", "x.*").withColumn("__c", F.explode(_literals(grid or scale_values()))).withColumn("scale", F.col("__c.scale"))
    y, p = F.col("y_true"), F.greatest(F.col("__p") * F.col("scale"), F.lit(0.0))
    ape = F.when(y > 0, F.abs(y - p) / F.greatest(y, F.lit(EPS)))
    sums = long.groupBy("weight_mode", "blend", "scale", "group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(y - p)).alias("ae"), F.sum(ape).alias("ape"), F.count(ape).alias("np"))
    sums = settled(sums)
    errors = [F.when(F.sum("np") > 0, F.sum("ape") / F.sum("np") * 100).alias("mape_quantity"), (F.sum("ae") / F.sum("n")).alias("mae_quantity")]
    # errors are compared to 9 digits, so that what differs only in the order of addition is a tie
    order = F.struct(F.coalesce(F.round("mape_quantity", 9), F.lit(float("inf"))), F.round("mae_quantity", 9), "scale")
    whole = sums.groupBy("weight_mode", "blend", "scale").agg(*errors)
    top = whole.groupBy("weight_mode", "blend").agg(F.min_by(F.struct("scale", "mape_quantity", "mae_quantity"), order).alias("b")).select("weight_mode", "blend", "b.*")
    raw = top.where(F.col("blend") == "raw_only")
    raw_of = raw.select("weight_mode", *(F.col(c).alias(f"__{c}") for c in ("scale", "mape_quantity", "mae_quantity")))
    log_mape = top.where(F.col("blend") == "log").select("mape_quantity").scalar()
    blends = top.where(~F.col("blend").isin("raw_only", "log")).join(raw_of, "weight_mode")
    falls = (F.col("blend") == "raw_log") & (F.col("__mape_quantity") <= log_mape)
    pick = lambda c: F.when(falls, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    blends = blends.select(F.concat_ws("_", "weight_mode", "blend").alias("candidate"), "weight_mode", F.when(falls, "raw_only").otherwise(F.col("blend")).alias("blend_mode"), *(pick(c) for c in ("scale", "mape_quantity", "mae_quantity")))
    plain = raw.select(F.concat(F.lit("raw_"), "weight_mode").alias("candidate"), "weight_mode", F.lit("raw_only").alias("blend_mode"), "scale", "mape_quantity", "mae_quantity")
    single = sums.where(F.col("blend") == "raw_only")
    per = single.where(F.col("np") > 0).groupBy("weight_mode", "group").agg(F.min(F.struct(F.round("ape", 9), "scale", (F.col("ape") / F.col("np") * 100).alias("m"))).alias("g"))
    every = rows.sparkSession.createDataFrame([(m, n) for m in modes for n in names], "weight_mode string, group string")
    scales = every.join(per, ["weight_mode", "group"], "left").join(raw_of, "weight_mode").select("weight_mode", "group", F.coalesce("g.scale", "__scale").alias("group_scale"), F.col("g.m").alias("group_mape"))
    chosen = single.join(scales, ["weight_mode", "group"]).where(F.col("scale") == F.col("group_scale")).groupBy("weight_mode").agg(*errors)
    beats = F.col("mape_quantity") < F.col("__mape_quantity")
    grouped = chosen.join(raw_of, "weight_mode").select(F.concat(F.lit("raw_"), "weight_mode", F.lit("_group")).alias("candidate"), "weight_mode", F.lit("raw_only").alias("blend_mode"), F.lit(None).cast("double").alias("scale"), "mape_quantity", "mae_quantity", beats.alias("beats_global"))
    table = plain.unionByName(blends).withColumn("beats_global", F.lit(None).cast("boolean")).unionByName(grouped)
    kind = F.when(F.col("beats_global").isNull(), "global_scale").otherwise("group_scale")
    return table.select("candidate", "weight_mode", "blend_mode", kind.alias("postprocess"), "scale", "mape_quantity", "mae_quantity", "beats_global"), scales


def extra_choices(table: DataFrame) -> DataFrame:
    """The candidates beside the raw ones that may be chosen: group scales that beat the global one, and blends with the
    baseline; if there are none, all with group scales. is_choice marks the first of them by error."""
    wanted = F.coalesce(F.col("beats_global"), F.lit(False)) | F.col("blend_mode").isin(*EXTRA_BLENDS)
    table = settled(table)
    some = table.where(wanted).groupBy().count().scalar() > 0
    rows = table.where(F.when(some, wanted).otherwise(F.col("candidate").endswith("_group")))
    key = lambda: F.struct(F.coalesce(F.round("mape_quantity", 9), F.lit(float("inf"))), F.round("mae_quantity", 9), "candidate")
    first = rows.agg(F.min_by("candidate", key())).scalar()
    return rows.withColumn("is_choice", F.col("candidate") == first)


def apply_tuned(rows: DataFrame, prediction: str, tuned: DataFrame) -> DataFrame:
    """location, item_id, prediction under the tuned cap and floor: rows have the caps (with_caps), tuned is one row
    with clip_kind, clip_mult and floor, taken into the plan as scalars."""
    kind, mult, floor = (tuned.select(c).scalar() for c in ("clip_kind", "clip_mult", "floor"))
    cut = capped(F.greatest(F.coalesce(F.col(prediction), F.lit(0.0)), F.lit(0.0)), cap_of(F.col("__kind")), F.col("__mult"))
    value = F.when(F.col("__cut") < F.col("__floor"), 0.0).otherwise(F.col("__cut"))
    read = rows.withColumns({"__kind": kind, "__mult": mult, "__floor": floor}).withColumn("__cut", cut)
    return read.select("location", "item_id", F.greatest(value, F.lit(0.0)).alias("prediction"))


def apply_weights(rows: DataFrame, weights: DataFrame, models: list[str]) -> DataFrame:
    """rows with prediction, the models' predictions (null as 0) under the weights: one row with w_<model>."""
    terms = [F.coalesce(F.col(m), F.lit(0.0)) * weights.select(f"w_{m}").scalar() for m in models]
    return rows.withColumn("prediction", F.greatest(sum(terms[1:], terms[0]), F.lit(0.0)))


def prediction_variants(rows: DataFrame, prediction: str, best_scale: float, delta: float = 0.025, control: str | None = None) -> DataFrame:
    """Output variants in one pass: location, item_id, variant, prediction for the raw one, the best scale and it less
    and plus delta, and the control output (another prediction as it is), if there is one."""
    scales = {"raw": 1.0, "best": best_scale, "best_minus": max(0.0, best_scale - delta), "best_plus": best_scale + delta}
    each = [F.struct(F.lit(n).alias("variant"), (F.col(prediction) * s).alias("__p")) for n, s in scales.items()]
    each += [F.struct(F.lit("control").alias("variant"), F.col(control).alias("__p"))] if control else []
    wide = rows.withColumn("__v", F.explode(F.array(*each)))
    return wide.select("location", "item_id", F.col("__v.variant").alias("variant"), F.greatest(F.col("__v.__p"), F.lit(0.0)).alias("prediction"))


def compare_runs(rows: DataFrame, models: list[str], y: str = "y_true") -> DataFrame:
    """Errors of several predictions by target group and over all ("all"), in one pass: model, target_group, n_pairs, mae, mape."""
    long = long_predictions(rows.select("location", "item_id", y, *models), models)
    groups = F.explode(F.array(target_group(F.col(y)), F.lit("all")))
    p = F.col("prediction")
    return long.withColumn("target_group", groups).groupBy("model", "target_group").agg(F.count(F.lit(1)).alias("n_pairs"), mae(F.col(y), p).alias("mae_quantity"), mape(F.col(y), p).alias("mape_quantity"))
