"""One row per entity with count, recency and total of each event type, from dense blocks."""

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = datetime.date(1970, 1, 1)
#: A feature column for each type: more would make rows too wide.
MOST_TYPES = 5000


def _exact_sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of int64 values by position. bincount adds doubles, so high and low halves are added apart; each
    stays exact up to 2**53 / 2**26 cells."""
    low = np.bincount(at, weights=(values & 0x3FFFFFF).astype(np.float64), minlength=size)
    high = np.bincount(at, weights=(values >> 26).astype(np.float64), minlength=size)
    return (high.astype(np.int64) << 26) + low.astype(np.int64)


def cells(df: DataFrame, entity: str, kind: str, day: str, value: str) -> DataFrame:
    """Counts, latest day and total by entity and type: n, last_day, total. The combine before the shuffle
    leaves at most one row per entity, type and input split, however hot an entity is."""
    return (
        df.where(F.col(entity).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(kind).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.col(day).cast("date")).alias("last_day"), F.sum(F.col(value).cast("bigint")).alias("total"))
    )


def feature_names(types: list[str]) -> list[str]:
    return [f"{t}__{m}" for t in types for m in ("count", "recency_days", "total")]


def feature_table(
    df: DataFrame, types: list[str], as_of: datetime.date | None = None, entity: str = "item_id", kind: str = "event_type",
    day: str = "event_date", value: str = "quantity", block_entities: int = 1024, form: str = "wide",
) -> DataFrame:
    """form="wide": one row per entity: for each type t the columns t__count (0 if none), t__recency_days (days from the
    latest dated event to as_of, by default the table's last day; negative after it, null if there is none) and t__total (sum of value, 0 if none).

    Entities are hashed into buckets; each bucket becomes a dense block entity x type, filled by numpy bincount
    (counts, totals) and a maximum scatter (latest day), and comes out as Arrow columns. A bucket gets
    aggregated cells only, at most len(types) of each of its entities.
    form="long": from the same blocks a row for each entity and type that occurs: entity, event_type, n,
    recency_days, total.

    A null entity has no row; types not listed (null too) give no features, but their entity has a row; a null
    day counts but has no recency; a null value counts and adds 0; repeated rows count each time; an empty
    table gives no rows. More than MOST_TYPES types make too wide a row: feature_groups gives their columns in several tables.
    """
    types = list(dict.fromkeys(types))
    if len(types) > MOST_TYPES:
        raise ValueError(f"{len(types)} types: more than {MOST_TYPES} make too wide a row; use feature_groups")
    names, width = feature_names(types), len(types)
    codes = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(types)], "__type string, __known int")
    slim = df.select(entity, F.col(kind).alias("__kind"), day, value)
    coded = slim.join(F.broadcast(codes), F.col("__kind") == F.col("__type"), "left")  # at most MOST_TYPES rows
    coded = coded.withColumn("__code", F.coalesce("__known", F.lit(-1)))
    # about so many buckets that one holds block_entities entities; the count is read from a sketch of all rows
    about, last_day = df.agg(F.approx_count_distinct(entity, 0.1), F.max(F.col(day).cast("date"))).first()
    today = ((as_of or last_day or EPOCH) - EPOCH).days
    buckets = max(1, -(-int(about) // block_entities))
    dense = cells(coded, entity, "__code", day, value).withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int"))
    long = T.StructType([T.StructField(entity, T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("n", T.LongType()), T.StructField("recency_days", T.IntegerType()), T.StructField("total", T.LongType())])
    schema = long if form == "long" else T.StructType([T.StructField(entity, T.StringType()), *(T.StructField(n, T.IntegerType() if n.endswith("recency_days") else T.LongType()) for n in names)])
    never = np.iinfo(np.int64).min

    def block(t: pa.Table) -> pa.Table:
        encoded = t.column("entity").combine_chunks().dictionary_encode()
        ids, row = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kinds = t.column("kind").to_numpy().astype(np.int64)
        on = kinds >= 0
        at, size = row[on] * width + kinds[on], len(ids) * width
        n = _exact_sums(at, t.column("n").to_numpy()[on], size).reshape(len(ids), width)
        total = _exact_sums(at, t.column("total").fill_null(0).to_numpy()[on], size).reshape(len(ids), width)
        days = t.column("last_day").cast(pa.int32()).fill_null(-(2**31)).to_numpy()[on].astype(np.int64)
        last = np.full(size, never)
        np.maximum.at(last, at, np.where(days == -(2**31), never, days))
        last = last.reshape(len(ids), width)
        if form == "long":
            i, j = np.nonzero(n)
            absent, days = last[i, j] == never, last[i, j]
            ago = pa.array(np.where(absent, 0, today - days).astype(np.int32), mask=absent)
            return pa.Table.from_arrays([ids.take(pa.array(i)), pa.array(types, pa.string()).take(pa.array(j)), pa.array(n[i, j]), ago, pa.array(total[i, j])], names=long.names)
        out = [ids]
        for i in range(width):
            absent = last[:, i] == never
            out += [pa.array(n[:, i]), pa.array(np.where(absent, 0, today - last[:, i]).astype(np.int32), mask=absent), pa.array(total[:, i])]
        return pa.Table.from_arrays(out, names=[entity, *names])

    return dense.select("bucket", "entity", "kind", "n", "last_day", "total").groupBy("bucket").applyInArrow(block, schema)


def feature_groups(df: DataFrame, types: list[str], as_of: datetime.date | None = None, most: int = MOST_TYPES, **kw: object) -> list[DataFrame]:
    """The feature table of any number of types, as tables of most types each, in the types' order. Every table has a
    row for each entity, so they can be joined by it or kept apart."""
    types = list(dict.fromkeys(types))
    return [feature_table(df, types[i : i + most], as_of, **kw) for i in range(0, max(1, len(types)), most)]
