"""Per-key results over tables in which a few keys hold most rows: two-stage salted aggregation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.tables import row_hash

#: How the partial results of one aggregate are made and merged.
PARTIAL = {"count": "count", "sum": "sum", "min": "min", "max": "max"}
MERGE = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}
#: Rows of a heavy key for each of its salts, beyond the least number of salts.
ROWS_PER_SALT = 1_000_000


def heavy_hashes(df: DataFrame, keys: list[str], heavy_share: float) -> tuple[int, list[tuple[int, int]]]:
    """The number of rows, and (hash of the key, about its rows) of all keys with at least heavy_share of them, from one
    pass with a bounded frequency sketch: a task sends the sketch, not a row per key.

    The sketch's counts are at most heavy_share/8 of all rows off, so no heavy key is missed; a lighter one that is
    listed too is salted without harm. At most 2/heavy_share keys come to the driver."""
    most = max(16, int(2 / heavy_share))
    tracked = 1 << max(9, int(32 / heavy_share - 1).bit_length())
    sketch = F.expr(f"approx_top_k(__h, {most}, {tracked})")
    n, top = df.select(F.xxhash64(*keys).alias("__h")).agg(F.count(F.lit(1)), sketch).first()
    return n, [(r["item"], r["count"]) for r in top or [] if r["item"] is not None and r["count"] >= 0.75 * heavy_share * n]


def salted(df: DataFrame, keys: list[str], heavy: list[tuple[int, int]], salts: int) -> DataFrame:
    """df with a column __salt: in rows of heavy keys 0 to s-1, where s follows the key's rows and is salts at the least;
    0 in all others. The broadcast list has a row per heavy key (see heavy_hashes)."""
    listed = [(h, max(salts, -(-n // ROWS_PER_SALT))) for h, n in heavy]
    mark = df.sparkSession.createDataFrame(listed, "__heavy bigint, __salts int")
    joined = df.withColumn("__hash", F.xxhash64(*keys)).withColumn("__spread", row_hash(df, 71)).join(F.broadcast(mark), F.col("__hash") == F.col("__heavy"), "left")
    return joined.select(*df.columns, F.coalesce(F.pmod("__spread", "__salts"), F.lit(0)).cast("int").alias("__salt"))


def salted_aggregate(
    df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]], heavy_share: float = 0.01, salts: int = 32,
) -> DataFrame:
    """One row per key with the named aggregates: name -> (count | sum | min | max | avg | count_distinct, column).

    Heavy keys are found by a bounded sketch over all rows; their rows get a salt (a hash of all columns of df: random in
    effect, equal when a lost task is redone; equal rows part only if df has a column like with_position's), partial
    results are made per key and salt, then merged per key. Distinct counts first reduce to distinct (key, value), which no
    key can pile up, then count per salt and add.

    Null keys form a key of their own; nulls in a value are left out, as in SQL; count with column "*"
    counts rows; an empty table gives no rows. Repeated rows count each time. Other columns of df only feed the salt.
    """
    columns = list(dict.fromkeys(c for _, c in aggregates.values() if c != "*"))
    data = df.select(*keys, *(c for c in columns if c not in keys))
    parts: dict[str, tuple[str, str]] = {}
    for kind, c in aggregates.values():
        for k in ("sum", "count") if kind == "avg" else (kind,) if kind in PARTIAL else ():
            parts[f"__{k}_{'rows' if c == '*' else c}"] = (k, c)
    first = [getattr(F, PARTIAL[k])(F.lit(1) if c == "*" else F.col(c)).alias(n) for n, (k, c) in parts.items()]
    second = [getattr(F, MERGE[k])(n).alias(n) for n, (k, _) in parts.items()]
    if first:
        _, heavy = heavy_hashes(df, keys, heavy_share)
        once = salted(df.select(*data.columns, row_hash(df, 71).alias("__row")), keys, heavy, salts).groupBy(*keys, "__salt").agg(*first)
        merged = once.groupBy(*keys).agg(*second)
    else:
        merged = data.select(*keys).distinct()
    for name, (kind, c) in aggregates.items():
        if kind == "count_distinct":
            single = data.select(*keys, F.col(c).alias("__value")).distinct()
            single = single.withColumn("__salt", F.pmod(F.xxhash64("__value"), F.lit(salts)))
            single = single.groupBy(*keys, "__salt").agg(F.count("__value").alias("__n"))
            single = single.groupBy(*keys).agg(F.sum("__n").alias(f"__distinct_{name}"))
            single = single.select(*(F.col(k).alias(f"__d_{k}") for k in keys), f"__distinct_{name}")
            same = None
            for k in keys:
                one = F.col(k).eqNullSafe(F.col(f"__d_{k}"))
                same = one if same is None else same & one
            merged = merged.join(single, same, "left").drop(*(f"__d_{k}" for k in keys))
    out = []
    for name, (kind, c) in aggregates.items():
        at = "rows" if c == "*" else c
        if kind == "avg":
            value = F.try_divide(F.col(f"__sum_{at}").cast("double"), F.col(f"__count_{at}"))
        elif kind == "count_distinct":
            value = F.coalesce(F.col(f"__distinct_{name}"), F.lit(0))
        else:
            value = F.col(f"__{kind}_{at}")
        out.append(value.alias(name))
    return merged.select(*keys, *out)
