"""Totals and averages over trailing periods for each entity and day, days without activity included."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Result rows that a task makes at most, about: its number of tasks follows the result, not the shuffle's bytes.
ROWS_PER_TASK = 16_000_000


def daily_totals(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Total per entity and day, as keys, day, total; rows with a null key or day too, as groups of their own. Combined before
    the shuffle: a hot entity is at most one row per day and input split."""
    return (
        df.select(*keys, F.col(day).cast("date").alias("day"), F.col(value).cast("bigint").alias("total"))
        .groupBy(*keys, "day")
        .agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    )


def _never_null(c: Column, kind: str) -> Column:
    """A column that has no null, known as such where it is text or a number: Parquet needs no mark for each of its values then."""
    if kind == "string":
        return F.coalesce(c, F.lit(""))
    return F.coalesce(c, F.lit(0).cast(kind)) if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else c


def _there(df: DataFrame, k: str) -> Column:
    """Whether a key is neither null nor not a number, as dropna() has it."""
    return F.col(k).isNotNull() & ~F.isnan(k) if dict(df.dtypes)[k] in ("float", "double") else F.col(k).isNotNull()


def rolling_totals(df: DataFrame, keys: list[str], day: str, value: str, windows: tuple[int, ...] = (7, 30), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per entity and day of the table's calendar (its first to its last day): keys, day, total (of the day) and,
    for each window w, total_wd over the w days that end with the day and avg_wd = total_wd / w (days without
    activity count as 0).

    Each daily total is exploded onto the dates at which its influence on a total begins or ends, and running totals along
    the entity's dates hold until its next such date (of equal dates the last has the sum of all, the others hold for no day): the
    calendar's dates in between (and those before the first one, which are zeros) are filled in from there. All of it after
    one shuffle of the daily totals by entity, and in the JVM.

    Rows with a null key or day are left out; a null value adds 0; negative values add as they are; repeated rows count
    each time; an empty table gives no rows. Other columns of df, of whatever name, play no part.
    """
    dated = df.dropna(subset=[*keys, day])
    low, high, rows = dated.agg(F.min(F.col(day).cast("date")), F.max(F.col(day).cast("date")), F.count(F.lit(1))).first()
    spans = {"total": 1, **{f"total_{w}d": w for w in windows}}
    length = 1 if low is None else (high - low).days + 1
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * length // rows_per_task))
    daily = daily_totals(df, keys, day, value).repartition(tasks, *keys)
    zero = F.lit(0).cast("bigint")
    # rows with a null key have no date from here on; dropped before, their keys would be worked out twice, in a method too long for the JIT
    at = F.when(reduce(and_, (_there(daily, k) for k in keys)), F.col("day"))
    edges = [F.struct(at.alias("__from"), *(F.col("total").alias(f"__{n}") for n in spans))]
    for w in sorted({*spans.values()}):
        edges.append(F.struct(F.date_add(at, w).alias("__from"), *((-F.col("total") if v == w else zero).alias(f"__{n}") for n, v in spans.items())))
    changes = daily.select(*keys, F.explode(F.array(*edges)).alias("__e")).select(*keys, "__e.*").where(F.col("__from") <= F.lit(high))
    order = Window.partitionBy(*keys).orderBy("__from")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    held = changes.select(*keys, "__from", F.lead("__from").over(order).alias("__next"), F.row_number().over(order).alias("__k"), *(F.coalesce(F.sum(f"__{n}").over(so_far), zero).alias(n) for n in spans))
    values = {n: F.col(n) for n in spans} | {f"avg_{w}d": F.coalesce(F.col(f"total_{w}d") / w, F.lit(0.0)) for w in windows}
    own = F.struct(F.col("__from").alias("a"), F.coalesce(F.date_sub("__next", 1), F.lit(high)).alias("b"), *(v.alias(n) for n, v in values.items()))
    before = F.struct(F.lit(low).alias("a"), F.date_sub("__from", 1).alias("b"), *((zero if n in spans else F.lit(0.0)).alias(n) for n in values))
    first = (F.col("__k") == 1) & (F.col("__from") > F.lit(low))
    kinds = dict(held.dtypes)
    stretches = held.select(*(_never_null(F.col(k), kinds[k]).alias(k) for k in keys), F.explode(F.when(first, F.array(before, own)).otherwise(F.array(own))).alias("__s")).select(*keys, "__s.*").where("a <= b")
    return stretches.select(*keys, F.explode(F.sequence("a", "b")).alias("day"), "total", *(n for w in windows for n in (f"total_{w}d", f"avg_{w}d")))
