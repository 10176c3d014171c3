"""Table readers, and tables that cut the lineage of a plan."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; a table may be a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def part_of_table(spark: SparkSession, folder: str, name: str, fraction: float = 1.0, seed: int = 42, most_splits: int = 0) -> DataFrame:
    """A table for trying things out: a random share of its rows, or the rows of its first input splits only (Parquet has them
    by row groups). Not used by any query."""
    df = table(spark, folder, name)
    if most_splits > 0:
        df = df.where(F.spark_partition_id() < most_splits)
    return df.sample(fraction, seed) if fraction < 1 else df


def first_column(df: DataFrame, *names: str) -> str | None:
    """The first of several possible columns that a table has."""
    return next((n for n in names if n in df.columns), None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only where that is unset (tests, a single
    machine) a local one is made."""
    spark_context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark_context.getCheckpointDir()
    if not folder:
        if not spark_context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyforge-")
    if not spark_context.getCheckpointDir():
        spark_context.setCheckpointDir(folder)
    return folder


def filesystem(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as the JVM knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = filesystem(spark, path)
    return files.exists(at)


_scratch: list[str] = []


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder. What is written there is deleted by release(), at the latest when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/tallyforge-{uuid.uuid4().hex}"
    at, files = filesystem(spark, path)
    files.deleteOnExit(at)
    _scratch.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes all scratch tables so far; their frames can't be read any more. For between two queries."""
    while _scratch:
        at, files = filesystem(spark, _scratch.pop())
        files.delete(at, True)


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, not lost with an executor, and in columns, so that
    a reader takes only those it needs and Spark knows the table's size."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_hash(df: DataFrame, seed: int = 0) -> "F.Column":
    """A hash of the whole row: spreads rows like a random number, but comes out the same if a task is redone."""
    kinds = dict(df.dtypes)
    usable = [F.col(f"`{c}`") for c in df.columns if not kinds[c].startswith("map")]
    return F.xxhash64(F.lit(seed), *usable)


def with_position(df: DataFrame, name: str = "__position") -> DataFrame:
    """A table read from files with a hash of each row's file and place in it: differs between equal rows, and comes
    out the same if a task is redone, however the files are split."""
    return df.withColumn(name, F.xxhash64("_metadata.file_name", "_metadata.row_index"))
