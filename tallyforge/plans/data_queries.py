"""Queries p1, p3, p4 and p5 over the event and purchase tables, each over whole tables, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import values as V
from tallyforge.operators.feature_table import MOST_TYPES, feature_table
from tallyforge.operators.orphans import OrphanState, replay
from tallyforge.operators.rolling import rolling_totals
from tallyforge.operators.skew import salted_aggregate
from tallyforge.plans.value_sql import item_sql, price_sql, type_sql
from tallyforge.sources.tables import table, with_position


def _features(spark: SparkSession, d: str, form: str) -> DataFrame:
    events = table(spark, d, "event_full_2025")
    listed = [r[0] for r in table(spark, d, "event_types").select("event_type").dropna().distinct().orderBy("event_type").limit(MOST_TYPES + 1).collect()]
    read = events.select(V.item_key(F.col("item_id")).alias("item_id"), V.token(F.col("event_type")).alias("event_type"), "event_date", "quantity")
    return feature_table(read, listed, form=form)


def p1_features(spark: SparkSession, d: str) -> DataFrame:
    """Problem 1: each item's count, recency and total quantity for every event type, as columns. Recency is in
    days before the table's last event_date. Rows delivered twice count twice."""
    return _features(spark, d, "wide")


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    """Problem 1, long form: the same features, a row per item and type that occurs."""
    return _features(spark, d, "long")


def p1_wide_rows(spark: SparkSession, d: str) -> DataFrame:
    """Problem 1: the wide table's columns as rows again, zeros and nulls included: item_id, feature, value."""
    wide = p1_features(spark, d)
    return wide.select("item_id", *(F.col(c).cast("bigint").alias(c) for c in wide.columns if c != "item_id")).unpivot("item_id", wide.columns[1:], "feature", "value")


def _sales(spark: SparkSession, d: str, *more: str) -> DataFrame:
    rows = table(spark, d, "transaction_full_2025")
    rows = with_position(rows) if "__position" in more else rows
    return rows.select(*more, V.valid_location(F.col("location")).alias("location"), V.item_key(F.col("item_id")).alias("item_id"), "updated_date", "quantity", "price", "customer_id")


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Problem 3: quantity over the trailing 7 and 30 days for each location and item and every day of the table; all
    rows with location, id and date count."""
    return rolling_totals(_sales(spark, d), ["location", "item_id"], "updated_date", "quantity")


def _orphans(spark: SparkSession, d: str) -> OrphanState:
    sales, events = table(spark, d, "transaction_full_2025"), table(spark, d, "event_full_2025")
    key = V.item_key(F.col("item_id")).alias("key")
    references = sales.select(F.lit("transaction_full_2025").alias("table_name"), key, F.col("updated_date").alias("at"))
    references = references.unionByName(events.select(F.lit("event_full_2025").alias("table_name"), key, F.col("event_date").alias("at")))
    log = table(spark, d, "item_log").select(key, V.action(F.col("action")).alias("action"), F.col("action_date").alias("at"))
    return replay(references, table(spark, d, "items").select(key), log)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 4: distinct orphan cases by table, month, item and reason, from the keyed state after its last batch."""
    return _orphans(spark, d).counts().select("table_name", "period", F.col("key").alias("item_id"), "reason")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Problem 4: orphan rows and items per table, month and reason: the state's last snapshot."""
    return _orphans(spark, d).snapshot()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: ids and valid locations that hold at least 3 % of all rows, from the salted per-key counts."""
    rows = with_position(table(spark, d, "transaction_full_2025"))
    total = rows.count()
    both = F.explode(F.array(
        F.struct(F.lit("item_id").alias("field"), V.item_key(F.col("item_id")).alias("key_value")),
        F.struct(F.lit("location").alias("field"), V.valid_location(F.col("location")).cast("string").alias("key_value")),
    ))
    keyed = rows.select(both.alias("k"), "__position").select("k.*", "__position").where(F.col("key_value").isNotNull())
    counts = salted_aggregate(keyed, ["field", "key_value"], {"n": ("count", "*")})
    return counts.where(F.col("n") * 100 >= 3 * total).select("field", "key_value")


def _per_key(spark: SparkSession, d: str, key: str) -> DataFrame:
    sales = _sales(spark, d, "__position").withColumn("amount", V.amount(F.col("price")))
    revenue = F.col("amount").cast("decimal(38,0)") * F.col("quantity")
    sales = sales.withColumn("revenue", revenue.cast("decimal(38,0)")).where(F.col(key).isNotNull())
    what = {"n_rows": ("count", "*"), "quantity": ("sum", "quantity"), "revenue": ("sum", "revenue"), "low_price": ("min", "amount"), "high_price": ("max", "amount"), "customers": ("count_distinct", "customer_id"), "mean_quantity": ("avg", "quantity")}
    return salted_aggregate(sales, [key], what).withColumn("revenue", F.col("revenue").cast("double"))


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: results for each item."""
    return _per_key(spark, d, "item_id")


def p5_locations(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: results for each valid location."""
    return _per_key(spark, d, "location")


QUERIES = {f.__name__: f for f in (p1_features, p1_cells, p1_wide_rows, p3_rolling, p4_found, p4_report, p5_found, p5_items, p5_locations)}


PAIRS = f"(select case when location >= 0 then location end as location, {item_sql()} as item_id, cast(updated_date as date) as day, quantity from transaction_full_2025)"


ROLLING = f"""
with daily as (select location, item_id, day, cast(coalesce(sum(quantity), 0) as bigint) as total from {PAIRS}
               where location is not null and item_id is not null and day is not null group by 1, 2, 3),
 ends as (select min(day) as low, max(day) as high from daily),
 pairs as (select distinct location, item_id from daily),
 dates as (select location, item_id, cast(unnest(generate_series(cast(low as timestamp), cast(high as timestamp), interval 1 day)) as date) as day from pairs, ends),
 filled as (select d.location, d.item_id, d.day, coalesce(x.total, 0) as total from dates d left join daily x using (location, item_id, day)),
 w as (select *, sum(total) over (partition by location, item_id order by day rows 6 preceding) as a, sum(total) over (partition by location, item_id order by day rows 29 preceding) as b from filled)
select location, item_id, day, cast(total as bigint) as total, cast(a as bigint) as total_7d, a / 7.0::double as avg_7d, cast(b as bigint) as total_30d, b / 30.0::double as avg_30d from w"""


def _per_key_sql(key: str) -> str:
    return f"""
with s as (select case when location >= 0 then location end as location, {item_sql()} as item_id, {price_sql()} as amount, quantity, customer_id from transaction_full_2025)
select {key}, count(*) as n_rows, cast(sum(quantity) as bigint) as quantity, cast(sum(cast(amount as hugeint) * quantity) as double) as revenue,
 min(amount) as low_price, max(amount) as high_price, count(distinct customer_id) as customers, cast(sum(quantity) as double) / count(quantity) as mean_quantity
from s where {key} is not null group by 1"""


CASES = f"""
with refs as (select 'transaction_full_2025' as table_name, {item_sql()} as id, updated_date as ts from transaction_full_2025
              union all select 'event_full_2025', {item_sql()}, event_date from event_full_2025),
 logs as (select {item_sql()} as id, regexp_replace(lower(action), '[^a-z]+', '', 'g') as act, action_date as ts from item_log),
 known as (select {item_sql()} as id from items union select id from logs),
 firsts as (select id, min_by(act, ts) as act, min(ts) as ts from logs group by 1),
 r as (select distinct table_name, id, ts from refs where id is not null and ts is not null),
 j as (select r.*, l.act as last_act from r asof left join logs l on r.id = l.id and r.ts >= l.ts),
 s as (select j.table_name, j.id, j.ts, case when k.id is null then 'missing' when j.last_act = 'delisted' then 'deleted'
       when j.last_act is null and f.act = 'listed' then 'later' end as reason
       from j left join known k on j.id = k.id left join firsts f on j.id = f.id)"""

SQL = {
    "p1_cells": f"""
with e as (select {item_sql()} as item_id, {type_sql()} as event_type, cast(event_date as date) as day, quantity from event_full_2025)
select item_id, event_type, count(*) as n, cast(date_diff('day', max(day), (select max(day) from e)) as int) as recency_days, cast(coalesce(sum(quantity), 0) as bigint) as total
from e where item_id is not null and event_type in (select event_type from event_types) group by 1, 2""",
    "p1_wide_rows": f"""
with e as (select {item_sql()} as item_id, {type_sql()} as event_type, cast(event_date as date) as day, quantity from event_full_2025),
 c as (select item_id, event_type, count(*) as n, date_diff('day', max(day), (select max(day) from e)) as ago, coalesce(sum(quantity), 0) as total from e group by 1, 2),
 w as (select i.item_id, t.event_type, coalesce(n, 0) as n, ago, coalesce(total, 0) as total from (select distinct item_id from e where item_id is not null) i, (select distinct event_type from event_types where event_type is not null) t left join c on c.item_id = i.item_id and c.event_type = t.event_type)
select item_id, event_type || '__count' as feature, cast(n as bigint) as value from w union all select item_id, event_type || '__recency_days', cast(ago as bigint) from w union all select item_id, event_type || '__total', cast(total as bigint) from w""",
    "p3_rolling": ROLLING,
    "p4_found": CASES + "\nselect distinct table_name, strftime(ts, '%Y-%m') as period, id as item_id, reason from s where reason is not null",
    "p4_report": CASES.replace("select distinct table_name, id, ts from refs", "select table_name, id, ts from refs")
    + "\nselect table_name, strftime(ts, '%Y-%m') as period, reason, count(*) as n_rows, count(distinct id) as n_keys from s where reason is not null group by 1, 2, 3",
    "p5_found": f"""
with k as (select 'item_id' as field, {item_sql()} as key_value from transaction_full_2025
           union all select 'location', cast(location as varchar) from transaction_full_2025 where location >= 0)
select field, key_value from k where key_value is not null group by 1, 2 having count(*) >= 0.03 * (select count(*) from transaction_full_2025)""",
    "p5_items": _per_key_sql("item_id"),
    "p5_locations": _per_key_sql("location"),
}
