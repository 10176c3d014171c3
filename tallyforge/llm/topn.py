"""The N best items of every group, by two-stage salted ranking."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted_top_n(df: DataFrame, groups: list[str], order: list[Column], spread: list[str], n: int, salts: int = 16, rank: str = "rank") -> DataFrame:
    """The first n rows of each group by order, with their place (1 to n) in the column rank.

    Rows are hashed by the columns spread into salts subgroups of their group; each subgroup keeps its first n
    (Spark keeps no more than n of a subgroup in a task before the shuffle either), and the at most salts*n survivors
    of a group are ranked again. A subgroup sorts on disk if it must, so no group has to fit anywhere.

    order has to end in what makes rows distinct (an identifier): equal rows are ranked in any order, but
    exactly n come out. Groups with fewer rows come out whole; null group columns make a group of their own; n < 1
    and empty tables give no rows. Other columns are kept.
    """
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in spread)), F.lit(salts)).cast("int")
    first = Window.partitionBy(*groups, "__salt").orderBy(*order)
    kept = df.withColumn("__salt", salt).withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= n)
    second = Window.partitionBy(*groups).orderBy(*order)
    return kept.drop("__salt", rank).withColumn(rank, F.row_number().over(second)).where(F.col(rank) <= n)


def best_rows(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Each key's highest score and, among its rows of that score, the highest tie value (null only if all are
    null). Both steps combine before their shuffle, so many rows of one key don't pile up."""
    by_score = df.groupBy(*keys, score).agg(F.max(tie).alias(tie))
    return by_score.groupBy(*keys).agg(F.max(score).alias(score), F.max_by(tie, score).alias(tie))
