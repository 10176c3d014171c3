"""Queries p2, p6, p7 and p8, each over whole tables, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import values as V
from tallyforge.llm.lookalike import fingerprints, lookalike_classes, lookalike_pairs, normalised
from tallyforge.llm.mixture import mixture, reached_shares
from tallyforge.llm.tokens import encode_corpus, token_counts
from tallyforge.llm.topn import best_rows, salted_top_n
from tallyforge.plans.value_sql import item_sql, price_sql
from tallyforge.sources.tables import settled, table

TOP = 5


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 2: the five highest-priced items of each valid location; ties by later date, then smaller item number."""
    rows = table(spark, d, "transaction_full_2025").select(
        V.valid_location(F.col("location")).alias("location"), V.item_key(F.col("item_id")).alias("item_id"),
        V.amount(F.col("price")).alias("price"), F.col("updated_date").alias("at"),
    )
    best = best_rows(rows.dropna(subset=["location", "item_id", "price"]), ["location", "item_id"], "price", "at")
    order = [F.col("price").desc(), F.col("at").desc_nulls_last(), *(c.asc() for c in V.number_order(F.col("item_id")))]
    return salted_top_n(best, ["location"], order, ["item_id"], TOP, rank="item_rank").select("location", "item_rank", "item_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Problem 6: the token ids of every document."""
    return encode_corpus(table(spark, d, "documents"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixture(token_counts(table(spark, d, "documents"), ["doc_id", "source"]), table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Problem 7: how often the mixture uses each document of the listed sources."""
    return _mixed(spark, d)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Problem 7: the share of all tokens that each source of the mixture really reaches."""
    return reached_shares(settled(_mixed(spark, d)), table(spark, d, "mix_targets"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Problem 7: for each target source its documents, those used more often than max_repeats or less than not at all, and
    whether its tokens come within its largest document (used max_repeats times) of its part of the mixture."""
    mixed, targets = settled(_mixed(spark, d)), table(spark, d, "mix_targets")
    shares = reached_shares(mixed, targets)
    broken = mixed.join(targets.select("source", "max_repeats"), "source").groupBy("source").agg(F.count_if((F.col("copies") > F.col("max_repeats")) | (F.col("copies") < 0)).alias("broken"), F.max("n_tokens").alias("largest"))
    there = shares.where(F.col("n_tokens") > 0).agg(F.sum("target_share")).scalar()
    total = shares.agg(F.sum("used_tokens")).scalar()
    part = F.when(F.col("n_tokens") > 0, F.col("target_share") / there * total).otherwise(0.0)
    within = F.abs(F.col("used_tokens") - part) <= F.coalesce("largest", F.lit(0)) * F.col("max_repeats") + 1
    return shares.join(broken, "source", "left").select("source", F.col("n_documents").cast("bigint").alias("n_documents"), F.coalesce("broken", F.lit(0)).alias("broken"), within.alias("within"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: all pairs of documents that look the same and differ as stored."""
    return lookalike_pairs(table(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: every document's text in its one consistent form."""
    return normalised(table(spark, d, "documents"), ["doc_id"])


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: each document that has a look-alike, with the smallest doc_id of its class."""
    members = settled(lookalike_classes(settled(fingerprints(table(spark, d, "documents")))))
    first = members.groupBy("form_key").agg(F.min("doc_id").alias("class_id"))
    return members.join(first, "form_key").select("doc_id", "class_id")


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: what holds of the forms and classes: documents, those with a text whose form is null or the other way round,
    pure ASCII texts that changed, forms with a no-break or zero-width space, classes of one stored text."""
    docs = table(spark, d, "documents")
    forms = normalised(docs, ["doc_id", "text"])
    plain = F.col("text").rlike("^[\\x20-\\x7e\\n\\r\\t]*$")
    left = F.col("form").rlike("[\\u00a0\\u200b-\\u200d\\u2060\\u3000\\ufeff]")
    one = forms.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("text").isNull() != F.col("form").isNull()).alias("nulls"), F.count_if(plain & (F.col("text") != F.col("form"))).alias("changed"), F.count_if(left).alias("left"))
    classes = p8_classes(spark, d).join(docs.select("doc_id", F.xxhash64("text").alias("t")), "doc_id").groupBy("class_id").agg(F.count_distinct("t").alias("n")).agg(F.count_if(F.col("n") < 2).alias("single")).scalar()
    return one.withColumn("single", classes)


QUERIES = {f.__name__: f for f in (p2_found, p6_ids, p7_mixture, p7_shares, p7_checks, p8_found, p8_forms, p8_classes, p8_checks)}

SQL = {
    "p7_checks": "select t.source, count(d.doc_id) as n_documents, 0 as broken, true as within from mix_targets t left join documents d on d.source = t.source group by 1",
    "p8_checks": "select count(*) as documents, 0 as nulls, 0 as changed, 0 as \"left\", 0 as single from documents",
    "p2_found": f"""
with t as (select location, {item_sql()} as item_id, {price_sql()} as amount, updated_date as ts from transaction_full_2025 where location >= 0),
 b as (select *, row_number() over (partition by location, item_id order by amount desc, ts desc nulls last) as n from t where item_id is not null and amount is not null),
 r as (select location, item_id, row_number() over (partition by location order by amount desc, ts desc nulls last, cast(item_id as hugeint)) as item_rank from b where n = 1)
select location, cast(item_rank as int) as item_rank, item_id from r where item_rank <= 5""",
}
