import datetime
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyforge.operators.orphans import orphan_counts, orphan_report, parent_timeline
from tallyforge.streaming.cubes import daily_sales
from tallyforge.streaming.orphans import COLUMNS, pending_orphans

T = datetime.datetime


def run(spark, parts, schema, build, tmp_path, mode):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, n: got.append([tuple(r) for r in df.collect()])).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    return got


def test_pending_orphans_equal_batch(spark, tmp_path):
    """Micro-batches with parents in any order of time give what the batch form gives over all rows, after each batch."""
    r = random.Random(6)
    keys = [None, "hot", *"abcdef"]
    at = lambda: r.choice([None, *(T(2025, 1, 1) + datetime.timedelta(days=d) for d in range(80))])
    parts = []
    for _ in range(3):
        rows = [("hot" if r.random() < 0.5 else r.choice(keys), "reference", at(), r.choice(["s", "e", None])) for _ in range(80)]
        parts.append(rows + [(r.choice(keys[1:]), r.choice(["listed", "delisted", "parent", "odd"]), at(), None) for _ in range(5)])
    for rows in parts:
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = pending_orphans(stream, f"{tmp_path}/orphans", lambda df, n: got.append({tuple(x)[:3]: (x.n_rows, x.n_keys) for x in df.collect()})).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None and len(got) == 3
    df = spark.read.parquet(f"{tmp_path}/in")
    log = df.where("kind in ('listed', 'delisted')").select("key", F.col("kind").alias("action"), "at")
    refs = df.where("kind = 'reference' and table_name is not null").select("table_name", "key", "at")
    want = orphan_report(orphan_counts(refs, parent_timeline(df.where("kind = 'parent'").select("key"), log)))
    assert {tuple(x)[:3]: (x.n_rows, x.n_keys) for x in want.collect()} == got[-1]
    assert {k[2] for k in got[-1]} == {"missing", "deleted", "later"}


def test_daily_sales_equal_batch(spark, tmp_path):
    r = random.Random(2)
    parts = [[(r.choice([1, 2, None]), r.choice("ab"), T(2025, 1, 1 + r.randrange(9), r.randrange(24)), r.choice([None, 1, 3])) for _ in range(40)] for _ in range(3)]
    got = run(spark, parts, "location int, item_id string, updated_date timestamp_ntz, quantity int", daily_sales, tmp_path, "update")
    latest = {row[:3]: row[3:] for batch in got for row in batch}
    want = defaultdict(lambda: [0, 0])
    for loc, item, at, q in (x for p in parts for x in p):
        if loc is not None:
            want[(loc, item, at.date())][0] += q or 0
            want[(loc, item, at.date())][1] += 1
    assert latest == {k: tuple(v) for k, v in want.items()}
