"""Profiles and output contracts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """A row per column: kind, rows, nulls, distinct values (exact), least and greatest as text. Counts of all columns
    come from one scan; distinct values are counted after being reduced to (column, value)."""
    columns = df.columns
    aggs = []
    for c in columns:
        aggs += [F.count(F.col(f"`{c}`")).alias(f"n|{c}"), F.min(F.col(f"`{c}`")).cast("string").alias(f"a|{c}"), F.max(F.col(f"`{c}`")).cast("string").alias(f"b|{c}")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    kinds = dict(df.dtypes)
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col("rows").alias("n_rows"), (F.col("rows") - F.col(f"`n|{c}`")).alias("n_nulls"), F.col(f"`a|{c}`").alias("least"), F.col(f"`b|{c}`").alias("greatest")) for c in columns)))
    summary = one.select(parts.alias("x")).select("x.*")
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns)))
    counts = df.select(values.alias("x")).select("x.*").distinct().groupBy("column").agg(F.count("value").alias("n_distinct"))
    return summary.join(counts, "column", "left").select("column", "kind", "n_rows", "n_nulls", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "least", "greatest")


def month_summary(sales: DataFrame) -> DataFrame:
    """Rows, quantity, revenue, pairs' items and locations per calendar month (yyyy-MM)."""
    month = F.substring(F.col("sale_date").cast("string"), 1, 7)
    return sales.groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("quantity").cast("bigint").alias("quantity"), F.sum(F.coalesce(F.col("quantity") * F.col("price"), F.lit(0))).cast("double").alias("revenue"),
        F.count_distinct("item_id").alias("n_items"), F.count_distinct("location").alias("n_locations"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def check_output(df: DataFrame, items: DataFrame | None = None, wanted: tuple[str, ...] = ("location", "item_id", "prediction")) -> DataFrame:
    """One row per check and its count of offences: columns (their order counts), nulls, not finite, negative, repeated keys,
    positive predictions of items with status 0."""
    spark, p = df.sparkSession, F.col(wanted[-1])
    keys = list(wanted[:-1])
    wrong = int(list(df.columns) != list(wanted))
    if any(c not in df.columns for c in wanted):
        return spark.createDataFrame([("columns", 1)], "check string, n bigint")
    nulls = None
    for c in wanted:
        nulls = F.col(c).isNull() if nulls is None else nulls | F.col(c).isNull()
    one = df.agg(F.count_if(nulls).alias("nulls"), F.count_if(F.isnan(p) | (F.abs(p) == float("inf"))).alias("not_finite"), F.count_if(p < 0).alias("negative"))
    rows = one.select(F.explode(F.array(F.struct(F.lit("columns").alias("check"), F.lit(wrong).cast("bigint").alias("n")), *(F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("nulls", "not_finite", "negative")))).alias("x")).select("x.*")
    twice = repeated_keys(df, keys).agg(F.lit("repeated_keys").alias("check"), F.coalesce(F.sum("n_rows") - F.count(F.lit(1)), F.lit(0)).alias("n"))
    rows = rows.unionByName(twice)
    if items is not None:
        off = df.where(p > 0).join(items.where(F.col("sale_status") == 0).select("item_id"), "item_id", "left_semi")
        rows = rows.unionByName(off.agg(F.lit("status_zero_positive").alias("check"), F.count(F.lit(1)).alias("n")))
    return rows


def check_many(outputs: dict[str, DataFrame | None], fallbacks: dict[str, str], items: DataFrame | None = None) -> DataFrame:
    """check_output of several candidate outputs: output, checked, check, n. One that is absent (None) is replaced by its
    fallback, if it has one, and else has a row "missing" with 1."""
    parts = []
    for name, df in outputs.items():
        used = name if df is not None else fallbacks.get(name)
        found = outputs.get(used) if used else None
        if found is None:
            spark = next(d for d in outputs.values() if d is not None).sparkSession
            rows = spark.createDataFrame([("missing", 1)], "check string, n bigint")
        else:
            rows = check_output(found, items)
        parts.append(rows.select(F.lit(name).alias("output"), F.lit(used if found is not None else "").alias("checked"), "check", F.col("n").cast("bigint").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_hints(columns: list[str], wanted: tuple[str, ...] = ("location", "item_id", "prediction")) -> list[str]:
    """What is wrong with an output's columns, in words: order, index columns, an older name of the prediction, missing keys."""
    hints = [] if list(columns) == list(wanted) else [f"columns must be {list(wanted)}, are {list(columns)}"]
    hints += [f"index column: {c}" for c in columns if c.startswith("Unnamed:")]
    if wanted[-1] not in columns:
        old = next((c for c in OLD_NAMES if c in columns), None)
        hints.append(f"rename {old} to {wanted[-1]}" if old else f"no column {wanted[-1]}")
    return hints + [f"no column {c}" for c in wanted[:-1] if c not in columns]


#: Earlier names of the prediction column.
OLD_NAMES = ("quantity", "quantity_pred", "pred", "prediction_blend", "sales")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def normalise_output(df: DataFrame) -> DataFrame:
    """Any earlier form of an output table in the contract's: older names of the prediction, index columns dropped,
    kinds cast (unreadable numbers 0), negatives 0, one row per key: the first, as the rows are read."""
    for old in OLD_NAMES:
        if old in df.columns and "prediction" not in df.columns:
            df = df.withColumnRenamed(old, "prediction")
    df = df.drop(*(c for c in df.columns if c.startswith("Unnamed") or c == "index"))
    p = F.col("prediction").try_cast("double")
    clean = F.greatest(F.coalesce(F.nanvl(p, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    read = df.select(F.col("location").try_cast("bigint").alias("location"), F.col("item_id").cast("string").alias("item_id"), clean.alias("prediction"), F.monotonically_increasing_id().alias("__at"))
    return read.groupBy("location", "item_id").agg(F.min_by("prediction", "__at").alias("prediction"))
