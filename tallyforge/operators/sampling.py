"""Samples with exact sizes by hash rank, and row weights. Same seed, same rows."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(keys: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(k) for k in keys))


def take_lowest_by(df: DataFrame, stratum: Column, wanted: dict[str, int], keys: list[str], seed: int) -> DataFrame:
    """Of each stratum (a text expression) the wanted number of rows, or all if there are no more: those with the lowest hashes of
    keys, read as unsigned numbers. Strata that aren't listed give none.

    No global sort, and one pass for all strata: counts of hash ranges (2**20 a stratum at most, summed before the shuffle) give
    the range in which the last wanted row falls; lower ranges come whole, and only that range is ordered. The list is a row
    per stratum."""
    h = hash_order(keys, seed)
    rows = df.select(F.struct(*df.columns).alias("__row"), stratum.alias("__s"), h.alias("__h"), F.shiftrightunsigned(h, 44).cast("int").alias("__b"))
    counts = rows.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__n"))
    listed = df.sparkSession.createDataFrame([(k, n) for k, n in wanted.items() if n > 0], "__s string, __wanted bigint")
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = counts.withColumn("__before", before).join(F.broadcast(listed), "__s").where(F.col("__before") < F.col("__wanted"))
    edge = edge.groupBy("__s").agg(F.max(F.struct("__b", (F.col("__wanted") - F.col("__before")).alias("__rest"))).alias("e")).select("__s", F.col("e.__b").alias("__edge"), F.col("e.__rest").alias("__rest"))
    near = rows.join(F.broadcast(edge), "__s").where(F.col("__b") <= F.col("__edge"))
    place = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h", *(F.col(f"__row.{k}") for k in keys)))
    low = near.where(F.col("__b") < F.col("__edge")).select("__row.*")
    last = near.where(F.col("__b") == F.col("__edge")).withColumn("__place", place).where(F.col("__place") <= F.col("__rest")).select("__row.*")
    return low.unionByName(last)


def take_lowest(df: DataFrame, n: int, keys: list[str], seed: int) -> DataFrame:
    """Exactly n rows (all, if there are no more): those with the lowest hashes of keys."""
    return take_lowest_by(df, F.lit("all"), {"all": n}, keys, seed)


def positive(target: str) -> Column:
    return F.coalesce(F.col(target) > 0, F.lit(False))


def first_counts(positives: int, zeros: int, max_rows: int) -> tuple[int, int]:
    """How many positives and zeros a sample has that takes positives first."""
    cap = max_rows if max_rows > 0 else positives + zeros
    return min(positives, cap), min(zeros, cap - min(positives, cap))


def sample(df: DataFrame, keys: list[str], max_rows: int = 0, ratio: float | None = None, target: str = "target", seed: int = 42) -> DataFrame:
    """At most max_rows rows (0: no cap): without a ratio positives first, zeros fill up; with one, that many zeros for each
    positive (ratio_counts). A negative ratio is none."""
    p, z = df.agg(F.count_if(positive(target)), F.count_if(~positive(target))).first()
    p, z = first_counts(p, z, max_rows) if ratio is None or ratio < 0 else ratio_counts(p, z, ratio, max_rows)
    return take_lowest_by(df, positive(target).cast("string"), {"true": p, "false": z}, keys, seed)


def positive_first(df: DataFrame, max_rows: int, keys: list[str], target: str = "target", seed: int = 42) -> DataFrame:
    """At most max_rows rows: positives first, zeros fill up. max_rows <= 0 or a small table keeps all rows."""
    return sample(df, keys, max_rows, None, target, seed)


def ratio_counts(positives: int, zeros: int, ratio: float, max_rows: int = 0) -> tuple[int, int]:
    """How many positives and zeros a sample has that wants ratio zeros for each positive.

    Without a cap: all positives and as many zeros as they call for. Under a cap that this exceeds, positives get their
    part 1/(1+ratio) of it (rounded to even, one at the least) and zeros the rest; if there are none to take the
    rest, positives do. Without any positive the sample is of zeros."""
    cap = max_rows if max_rows > 0 else positives + zeros
    called = min(zeros, math.ceil(positives * ratio)) if positives else zeros
    part = positives if positives + called <= cap else min(positives, max(1, round(cap / (1.0 + max(ratio, 0.0)))))
    rest = min(called if part == positives else zeros, cap - part)
    return (part, rest) if rest or not positives else (min(positives, cap), 0)


def negative_ratio(df: DataFrame, ratio: float, keys: list[str], max_rows: int = 0, target: str = "target", seed: int = 42) -> DataFrame:
    """ratio zeros for each positive, under a row cap."""
    return sample(df, keys, max_rows, ratio, target, seed)


def sample_months(df: DataFrame, total: int, month: str, keys: list[str], target: str = "target", seed: int = 42, ratio: float | None = None) -> DataFrame:
    """A budget of ceil(total/months) for each month, then the total cap over all. All months are counted in one pass and
    taken in one; only counts, a row per month, come to the driver."""
    counts = df.where(F.col(month).isNotNull()).groupBy(month).agg(F.count_if(positive(target)), F.count_if(~positive(target))).collect()  # a row per month
    budget, wanted = math.ceil(total / max(1, len(counts))), {}
    for m, p, z in counts:
        p, z = first_counts(p, z, budget) if ratio is None or ratio < 0 else ratio_counts(p, z, ratio, budget)
        wanted |= {f"{m} true": p, f"{m} false": z}
    kept = take_lowest_by(df, F.concat_ws(" ", F.col(month).cast("string"), positive(target).cast("string")), wanted, keys, seed)
    return kept if sum(wanted.values()) <= total else sample(kept, keys, total, ratio, target, seed + 99)


def row_weight(y: Column, mode: str = "inv_y", zero_weight: float = 1.0) -> Column:
    """none: 1; inv_y: 1/max(y,1); inv_sqrt_y: 1/sqrt(max(y,1)); rows with y <= 0 get zero_weight in both of these."""
    safe = F.greatest(y, F.lit(1.0))
    if mode == "none":
        return F.lit(1.0)
    if mode not in ("inv_y", "inv_sqrt_y") or zero_weight < 0:
        raise ValueError(f"no such weights: {mode}, {zero_weight}")
    return F.when(y <= 0, F.lit(float(zero_weight))).otherwise(1.0 / (safe if mode == "inv_y" else F.sqrt(safe)))


def diagnostic(df: DataFrame, month: str = "t", target: str = "target") -> DataFrame:
    """Rows, positives, zeros and the share of positives by month."""
    y = F.col(target)
    return df.groupBy(month).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(y > 0).alias("positives"), F.count_if(y <= 0).alias("zeros"), F.avg((y > 0).cast("double")).alias("positive_rate"), F.sum(y).alias("target_sum"))
