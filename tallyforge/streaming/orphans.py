"""Pending orphan references kept per key while references and parents arrive as a stream."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyforge.operators.orphans import OrphanState

COLUMNS = "key string, kind string, at timestamp_ntz, table_name string"


def pending_orphans(arrivals: DataFrame, folder: str, snapshot: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that brings each micro-batch of arrivals (COLUMNS; kind is "reference", "parent", "listed" or "delisted") into the
    OrphanState in folder, and gives snapshot, if there is one, its counts per table, month and reason after each batch.

    It is the state of the batch replay: references, and parents of any time, may come in any order. Null keys, other
    kinds, references without table or time have no effect; listings without a time make their key known. A batch that
    is repeated after a failure replaces what it wrote. Start it with a checkpointLocation."""
    spark = arrivals.sparkSession

    def take(df: DataFrame, batch: int) -> None:
        state, kind = OrphanState(spark, folder), F.col("kind")
        df = df.persist()
        refs, log = df.where(kind == "reference"), df.where(kind.isin("listed", "delisted"))
        state.advance(int(batch), refs.select("key", "table_name", "at"), df.where(kind == "parent").select("key"), log.select("key", kind.alias("action"), "at"))
        df.unpersist()
        if snapshot:
            snapshot(state.snapshot(), int(batch))

    return arrivals.writeStream.foreachBatch(take)
