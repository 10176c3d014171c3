"""Sinks and the registry of stage tables."""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.tables import exists, filesystem, table

OUTPUT = "location bigint, item_id string, prediction double"


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces a table. Spark's commit makes files visible at the end; readers look for _SUCCESS."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header. one_file is for small results only: it takes a single task."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def read_output_csv(spark: SparkSession, path: str) -> DataFrame:
    """An output table from CSV, item ids as text."""
    return spark.read.schema(OUTPUT).option("header", True).csv(path)


def output_frame(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """The contract's columns and kinds: numbers not below 0, unreadable ones 0."""
    p = F.col(prediction).try_cast("double")
    return df.select(F.col("location").cast("bigint").alias("location"), F.col("item_id").cast("string").alias("item_id"), F.greatest(F.coalesce(F.nanvl(p, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("prediction"))


def portal_frame(df: DataFrame) -> DataFrame:
    """location, item_id and quantity as bigint, bigint and double; an id that is no number is an error."""
    return df.select(F.col("location").cast("bigint").alias("location"), F.col("item_id").cast("bigint").alias("item_id"), F.col("prediction").cast("double").alias("quantity"))


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small artifact (parameters, status) on any file system, written beside and moved into place."""
    at, files = filesystem(spark, path)
    beside, _ = filesystem(spark, path + ".part")
    out = files.create(beside, True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, default=str).encode()))
    out.close()
    files.delete(at, False)
    if not files.rename(beside, at):
        raise OSError(f"{path} could not be moved into place")


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The artifact, or None if there is none."""
    if not exists(spark, path):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report table of a small result. Beyond most rows it says how many there are and which are shown."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    return "\n".join(lines + ["", f"The first {most} of {df.count()} rows."] * (len(rows) > most)) + "\n"


def write_report(spark: SparkSession, path: str, parts: dict[str, DataFrame]) -> None:
    """Several small results as one Markdown file on any file system."""
    at, files = filesystem(spark, path)
    out = files.create(at, True)
    out.write(bytearray("\n".join(markdown(df, title) for title, df in parts.items()).encode()))
    out.close()


class Stages:
    """Tables of named stages under one folder: a stage is done if its table was committed."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def done(self, name: str) -> bool:
        return exists(self.spark, f"{self.folder}/{name}.parquet/_SUCCESS")

    def read(self, name: str) -> DataFrame:
        if not self.done(name):
            raise ValueError(f"run the stage {name} first")
        return table(self.spark, self.folder, name)

    def run(self, name: str, build: Callable[[], DataFrame], force: bool = False, version: str | None = None) -> DataFrame:
        """The stage's table, built if it isn't there yet, force is set, or it was built under another version (such as that
        of the model behind it)."""
        stale = version is not None and (read_json(self.spark, f"{self.folder}/{name}.version.json") or {}).get("version") != version
        if force or stale or not self.done(name):
            write_parquet(build(), f"{self.folder}/{name}.parquet")
            if version is not None:
                write_json(self.spark, f"{self.folder}/{name}.version.json", {"version": version})
        return self.read(name)

    def status(self, names: list[str]) -> dict[str, bool]:
        return {n: self.done(n) for n in names}
