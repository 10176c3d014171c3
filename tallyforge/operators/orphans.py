"""References to keys that are missing, deleted or not there yet: keyed state of references and parents, kept incrementally."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.sources.tables import exists, scratch_path

#: Sort places at one instant: what was known from the start, a deletion, a listing, then references.
START, DELETED, LISTED, REFERENCE = 0, 1, 2, 9
#: Rows of a key in one replayed part; a key with more is replayed in as many parts as that takes.
PER_PART = 1_000_000
CHANGES = "key string, at timestamp_ntz, place int"
STATES = "key string, source string, at timestamp_ntz, n bigint, reason string"


def parent_changes(parents: DataFrame, log: DataFrame) -> DataFrame:
    """What parents do, as distinct key, at, place. parents has a column key; log has key, action ("listed" or "delisted"),
    at. Each known key has one row at the start (at null), then one per distinct dated action.

    Null keys are dropped; log rows without a date or with another action make their key known, no more."""
    known = parents.select("key").unionByName(log.select("key")).dropna()
    known = known.select("key", F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(START).alias("place"))
    acts = log.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("listed", "delisted"))
    acts = acts.select("key", F.col("at").cast("timestamp_ntz").alias("at"), F.when(F.col("action") == "delisted", DELETED).otherwise(LISTED).alias("place"))
    return known.unionByName(acts).distinct()


def timeline(changes: DataFrame) -> DataFrame:
    """changes with the state from each on: at the start "later" if the key's first dated action lists it, else "there"; then
    "deleted" or "there". Of a deletion and a listing at one instant the listing counts as the later one."""
    dated = F.when(F.col("place") != START, F.struct("at", "place"))
    first = changes.groupBy("key").agg(F.min(dated).alias("first"))
    start = first.select("key", F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(START).alias("place"), F.when(F.col("first.place") == LISTED, "later").otherwise("there").alias("state"))
    return start.unionByName(changes.where(F.col("place") != START).withColumn("state", F.when(F.col("place") == DELETED, "deleted").otherwise("there")))


def parent_timeline(parents: DataFrame, log: DataFrame) -> DataFrame:
    return timeline(parent_changes(parents, log))


def reference_states(references: DataFrame, timeline: DataFrame, per_part: int = PER_PART, rows: Column | None = None) -> DataFrame:
    """references (key, at and any other columns) with the state of their key at that instant: "there",
    "deleted", "later" or "missing".

    Changes and references of a key are replayed in order of time and the last state is carried along, so
    each reference probes the state as it was. The number of a key's parts follows its rows (about per_part each); each
    part has all of the key's changes. Which keys have more than one part is a table of at most rows/per_part rows; how it is
    joined is left to Spark's size rules. rows is an expression that is 1 for each reference: one over the references' own
    columns lets Spark count them and replay them from the same shuffle.

    References without key or time are left out. Equal references each get a row.
    """
    extra = [c for c in references.columns if c not in ("key", "at")]
    asked = references.where(F.col("key").isNotNull() & F.col("at").isNotNull())
    large = asked.groupBy("key").agg(F.ceil(F.sum(F.lit(1) if rows is None else rows) / per_part).cast("int").alias("__parts")).where(F.col("__parts") > 1)
    part = F.coalesce(F.pmod(F.xxhash64("at", *extra), "__parts"), F.lit(0)).cast("int")
    rows = asked.join(large, "key", "left").select("key", "at", *extra, part.alias("__part"), F.lit(REFERENCE).alias("place"), F.lit(None).cast("string").alias("state"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    known = timeline.join(large, "key", "left").withColumn("__part", copies).drop("__parts")
    replay = rows.unionByName(known, allowMissingColumns=True)
    order = Window.partitionBy("key", "__part").orderBy(F.col("at").asc_nulls_first(), "place").rowsBetween(Window.unboundedPreceding, 0)
    carried = replay.withColumn("state", F.coalesce(F.last("state", ignorenulls=True).over(order), F.lit("missing")))
    return carried.where(F.col("place") == REFERENCE).select("key", "at", *extra, "state")


def combined(references: DataFrame, source: str = "table_name") -> DataFrame:
    """References of one key, table and instant as one row with their number: key, source, at, n. Combined before the shuffle."""
    kept = references.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col(source).isNotNull())
    return kept.groupBy("key", F.col(source).alias("source"), F.col("at").cast("timestamp_ntz").alias("at")).agg(F.count(F.lit(1)).alias("n"))


class OrphanState:
    """References and their parents as they arrive in batches, kept as tables in the shared folder: for each key its parent's
    changes (the parent index), and its references with the reason for which they are orphans, or "there".

    advance() takes one batch: its references probe the parent index; a key of which a new change arrives, in whatever order of
    time, has its waiting references judged anew, which resolves orphans whose parent has come, reopens those of
    a parent that turns out to be deleted, and tells "missing" from "later". Each batch only writes its new changes and what it
    judged; a judged row holds until a later batch has changes of its key.

    Batches are numbered; a batch that is repeated after a failure replaces what it wrote before."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, (folder or scratch_path(spark)).rstrip("/")

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        at = f"{self.folder}/{name}"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        df = self.spark.read.schema(f"{schema}, batch int").parquet(at)
        return df if before is None else df.where(F.col("batch") < before)

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        at = f"{self.folder}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def current(self, before: int | None = None) -> DataFrame:
        """key, source, at, n, reason of all references so far."""
        refs = self._read("refs", STATES, before)
        later = self._read("changes", CHANGES, before).where(F.col("batch") > 0)  # rows of batch 0 can't be older than its changes
        last = later.groupBy("key").agg(F.max("batch").alias("last"))
        return refs.join(last, "key", "left").where(F.col("last").isNull() | (F.col("batch") >= F.col("last"))).drop("batch", "last")

    def advance(self, batch: int, references: DataFrame, parents: DataFrame, log: DataFrame) -> None:
        """references: key, table_name, at; parents: key; log: key, action, at. Null keys, references without table or time have no effect."""
        first = not exists(self.spark, f"{self.folder}/changes")
        known, new = self._read("changes", CHANGES, batch).drop("batch"), parent_changes(parents, log)
        if not first:
            same = (F.col("a.key") == F.col("b.key")) & (F.col("a.place") == F.col("b.place")) & F.col("a.at").eqNullSafe(F.col("b.at"))
            new = new.alias("a").join(known.alias("b"), same, "left_anti")
        new = self._write(new, "changes", batch)
        asked = combined(references)
        if not first:
            asked = asked.unionByName(self.current(batch).drop("reason").join(new.select("key").distinct(), "key", "left_semi"))
        states = reference_states(asked, timeline(known.unionByName(new)), rows=F.least("n", F.lit(1)))
        self._write(states.select("key", "source", "at", "n", F.col("state").alias("reason")), "refs", batch)

    def counts(self) -> DataFrame:
        """Orphan references: table_name, period (YYYY-MM), key, reason, n."""
        month = F.year("at") * 12 + F.month("at") - 1
        groups = self.current().where(F.col("reason") != "there").groupBy("source", month.alias("month"), "key", "reason").agg(F.sum("n").alias("n"))
        period = F.format_string("%04d-%02d", F.floor(F.col("month") / 12).cast("int"), F.col("month") % 12 + 1)
        return groups.select(F.col("source").alias("table_name"), period.alias("period"), "key", "reason", "n")

    def snapshot(self) -> DataFrame:
        """Orphan references and their distinct keys per table, period and reason, as of the last batch."""
        return orphan_report(self.counts())


def replay(references: DataFrame, parents: DataFrame, log: DataFrame, slices: int = 2) -> OrphanState:
    """Whole tables through the state, in slices of time of about equal numbers of references; parents without a date come
    first. The slices' bounds are approximate quantiles; which slice a row comes in has no part in the result."""
    state = OrphanState(references.sparkSession)
    at = F.col("at").cast("timestamp_ntz")
    seconds = F.unix_timestamp(F.col("at").cast("timestamp"))
    marks = [i / slices for i in range(1, slices)]
    cuts = (references.agg(F.percentile_approx(seconds, marks, 1000)).first()[0] if marks else None) or []
    bounds = [None, *sorted({*cuts}), None]
    moments = [None if b is None else F.timestamp_seconds(F.lit(b)).cast("timestamp_ntz") for b in bounds]
    for i, (a, b) in enumerate(zip(moments, moments[1:])):
        inside = lambda first: (F.lit(True) if a is None else at >= a) & (F.lit(True) if b is None else at < b) | (F.lit(first) & at.isNull())  # noqa: B023, E731
        state.advance(i, references.where(inside(False)), parents if i == 0 else parents.limit(0), log.where(inside(i == 0)))
    return state


def orphan_counts(references: DataFrame, timeline: DataFrame, source: str = "table_name") -> DataFrame:
    """The same in one batch over whole tables, without state: source, period (YYYY-MM), key, reason, n."""
    states = reference_states(references, timeline).where(F.col("state") != "there")
    month = F.year("at") * 12 + F.month("at") - 1
    groups = states.groupBy(source, month.alias("month"), "key", F.col("state").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    period = F.format_string("%04d-%02d", F.floor(F.col("month") / 12).cast("int"), F.col("month") % 12 + 1)
    return groups.select(source, period.alias("period"), "key", "reason", "n")


def orphan_report(counts: DataFrame, source: str = "table_name") -> DataFrame:
    """A snapshot per source, period and reason: rows and distinct keys that are orphans."""
    return counts.groupBy(source, "period", "reason").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
