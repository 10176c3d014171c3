import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.feature_table import feature_groups, feature_table
from tallyforge.operators.orphans import OrphanState, orphan_counts, orphan_report, parent_timeline, reference_states, replay
from tallyforge.operators.rolling import rolling_totals
from tallyforge.operators import skew
from tallyforge.operators.skew import heavy_hashes, salted, salted_aggregate

D = datetime.date
T = datetime.datetime


def skewed(n=4000, seed=5):
    """A third of the rows on one key; nulls in all columns; repeated rows."""
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.34 else r.choice([None, *"abcdefgh"]), r.choice([None, -3, 0, 1, 2, 5]), r.choice([None, *range(30)])) for _ in range(n)]
    return rows + rows[:50]


@pytest.mark.parametrize("heavy_share,salts", [(0.01, 8), (0.9, 1), (0.2, 32)])
def test_salted_aggregate_equals_plain(spark, heavy_share, salts):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, v int, w int").withColumn("__heavy", F.lit(1))
    what = {"n": ("count", "*"), "nv": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "mean": ("avg", "v"), "d": ("count_distinct", "w")}
    got = {r.k: tuple(r)[1:] for r in salted_aggregate(df, ["k"], what, heavy_share=heavy_share, salts=salts).collect()}
    by = defaultdict(list)
    for k, v, w in rows:
        by[k].append((v, w))
    want = {}
    for k, x in by.items():
        v = [a for a, _ in x if a is not None]
        want[k] = (len(x), len(v), sum(v), min(v), max(v), sum(v) / len(v), len({b for _, b in x if b is not None}))
    assert got == want


def test_heavy_rows_spread(spark, monkeypatch):
    df = spark.createDataFrame([("hot", i) for i in range(1000)] + [(str(i), i) for i in range(100)], "k string, v int")
    n, heavy = heavy_hashes(df, ["k"], 0.1)
    assert n == 1100 and [c for _, c in heavy] == [1000]
    spread = lambda: Counter(r[0] for r in salted(df, ["k"], heavy, 8).where("k = 'hot'").select("__salt").collect())
    counts = spread()
    assert len(counts) == 8 and max(counts.values()) < 250
    assert {r[0] for r in salted(df, ["k"], heavy, 8).where("k <> 'hot'").select("__salt").distinct().collect()} == {0}
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 50)  # the number of salts follows the key's rows
    assert len(spread()) == 20


def test_no_heavy_key_is_missed(spark):
    r = random.Random(3)
    keys = [f"h{i}" for i in range(30) for _ in range(1000)] + [f"l{i}" for i in range(60_000)]
    r.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    found = {h for h, _ in heavy_hashes(df, ["k"], 0.01)[1]}
    assert {x.h for x in df.where("k like 'h%'").select(F.xxhash64("k").alias("h")).distinct().collect()} <= found and len(found) < 60


def test_salted_aggregate_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert salted_aggregate(empty, ["k"], {"n": ("count", "*"), "d": ("count_distinct", "v"), "m": ("avg", "v")}).collect() == []
    nulls = spark.createDataFrame([(None, None)] * 3, "k string, v int")
    assert [tuple(r) for r in salted_aggregate(nulls, ["k"], {"n": ("count", "*"), "d": ("count_distinct", "v"), "m": ("avg", "v"), "s": ("sum", "v")}).collect()] == [(None, 3, 0, None, None)]


def event_rows(seed=3, n=3000):
    r = random.Random(seed)
    days = [D(2025, 1, 1) + datetime.timedelta(days=i) for i in range(60)]
    return [("hot" if r.random() < 0.4 else r.choice([None, *map(str, range(40))]), r.choice(["view", "cart", "odd", None]), r.choice([None, *days]), r.choice([None, 1, 2, -4, 1 << 40])) for _ in range(n)]


def brute_features(rows, types, as_of):
    out = defaultdict(lambda: {t: [0, None, 0] for t in types})
    for e, t, d, q in rows:
        if e is None:
            continue
        cell = out[e].get(t)
        if cell:
            cell[0] += 1
            cell[2] += q or 0
            if d and (cell[1] is None or d > cell[1]):
                cell[1] = d
    return {e: {t: (n, None if d is None else (as_of - d).days, q) for t, (n, d, q) in c.items()} for e, c in out.items()}


@pytest.mark.parametrize("block", [4, 1000])
def test_feature_table(spark, block):
    rows, types, as_of = event_rows(), ["view", "cart", "never"], D(2025, 2, 15)
    df = spark.createDataFrame(rows, "item_id string, event_type string, event_date date, quantity bigint").withColumn("entity", F.lit("clash"))
    want = brute_features(rows, types, as_of)
    wide = feature_table(df, types, as_of, block_entities=block)
    got = {r.item_id: {t: (r[f"{t}__count"], r[f"{t}__recency_days"], r[f"{t}__total"]) for t in types} for r in wide.collect()}
    assert got == want
    long = feature_table(df, types, as_of, block_entities=block, form="long").collect()
    assert {(r.item_id, r.event_type): (r.n, r.recency_days, r.total) for r in long} == {(e, t): c for e, x in want.items() for t, c in x.items() if c[0]}


def test_groups_of_columns_are_the_whole_table(spark):
    rows, types = event_rows(5, 600), ["view", "cart", "odd", "never"]
    df = spark.createDataFrame(rows, "item_id string, event_type string, event_date date, quantity bigint")
    parts = feature_groups(df, types, most=3)
    assert [len(p.columns) for p in parts] == [10, 4]
    whole = {r[0]: tuple(r)[1:] for r in feature_table(df, types).collect()}
    first, second = ({r[0]: tuple(r)[1:] for r in p.collect()} for p in parts)
    assert whole == {k: first[k] + second[k] for k in first} and first.keys() == second.keys()


def test_feature_table_edges(spark):
    empty = spark.createDataFrame([], "item_id string, event_type string, event_date date, quantity int")
    assert feature_table(empty, ["view"], D(2025, 1, 1)).collect() == []
    one = spark.createDataFrame([("a", "x", None, None)], "item_id string, event_type string, event_date date, quantity int")
    assert [tuple(r) for r in feature_table(one, [], D(2025, 1, 1)).collect()] == [("a",)]
    assert [tuple(r) for r in feature_table(one, ["x"], D(2025, 1, 1)).collect()] == [("a", 1, None, 0)]
    with pytest.raises(ValueError):
        feature_table(one, [str(i) for i in range(5001)], D(2025, 1, 1))


def brute_rolling(rows):
    daily = defaultdict(int)
    for loc, item, at, q in rows:
        if loc is not None and item is not None and at is not None:
            daily[(loc, item, at.date())] += q or 0
    if not daily:
        return {}
    low, high = min(k[2] for k in daily), max(k[2] for k in daily)
    out = {}
    for pair in {k[:2] for k in daily}:
        day = low
        while day <= high:
            w = [sum(daily.get((*pair, day - datetime.timedelta(days=i)), 0) for i in range(n)) for n in (7, 30)]
            out[(*pair, day)] = (daily.get((*pair, day), 0), w[0], w[0] / 7, w[1], w[1] / 30)
            day += datetime.timedelta(days=1)
    return out


@pytest.mark.parametrize("per_task", [100, 16_000_000])
def test_rolling(spark, per_task):
    r = random.Random(9)
    rows = [(1 if r.random() < 0.4 else r.choice([None, 2, 3]), r.choice(["a", "b", None, "aa"]), r.choice([None, T(2025, 1, 1, 5) + datetime.timedelta(days=r.randrange(90), hours=r.randrange(20))]), r.choice([None, 1, 2, -3])) for _ in range(150)]
    rows += [(7, "once", T(2025, 2, 3), None), (8, "twice", T(2025, 2, 3), 2), (8, "twice", T(2025, 2, 3), 2)]
    df = spark.createDataFrame(rows, "location int, item_id string, updated_date timestamp_ntz, quantity int").withColumn("day", F.lit("clash")).withColumn("total", F.lit(1)).withColumn("__from", F.lit(1))
    got = [tuple(x) for x in rolling_totals(df, ["location", "item_id"], "updated_date", "quantity", rows_per_task=per_task).collect()]
    assert len(got) == len({x[:3] for x in got}) and {x[:3]: x[3:] for x in got} == brute_rolling(rows)


def test_rolling_other_windows_and_empty(spark):
    df = spark.createDataFrame([(None, "a", None, 1)], "location int, item_id string, updated_date timestamp_ntz, quantity int")
    assert rolling_totals(df, ["location", "item_id"], "updated_date", "quantity").collect() == []
    one = spark.createDataFrame([("a", D(2025, 1, 1), 1), ("a", D(2025, 1, 4), 5)], "k string, d date, q int")
    got = {r.day.day: (r.total, r.total_1d, r.total_2d) for r in rolling_totals(one, ["k"], "d", "q", (1, 2)).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 0, 1), 3: (0, 0, 0), 4: (5, 5, 5)}


def test_rolling_keys_that_are_no_numbers(spark):
    df = spark.createDataFrame([(1.5, D(2025, 1, 1), 2), (1.5, D(2025, 1, 2), 3), (float("nan"), D(2025, 1, 2), 4), (None, D(2025, 1, 3), 5)], "k double, d date, q int")
    got = rolling_totals(df, ["k"], "d", "q", (2,))
    assert not any(f.nullable for f in got.schema) and sorted(tuple(r) for r in got.collect()) == [(1.5, D(2025, 1, 1), 2, 2, 1.0), (1.5, D(2025, 1, 2), 3, 5, 2.5)]


def brute_state(key, at, parents, log):
    rows = sorted((a, act != "delisted") for k, act, a in log if k == key and a is not None and act in ("listed", "delisted"))
    if key not in parents and key not in {k for k, _, _ in log}:
        return "missing"
    before = [x for x in rows if x[0] <= at]
    if before:
        return "there" if before[-1][1] else "deleted"
    return "later" if rows and rows[0][1] else "there"


def orphan_rows(seed=4):
    r = random.Random(seed)
    moments = [T(2025, 1, 1) + datetime.timedelta(days=i) for i in range(0, 120, 3)]
    keys = [str(i) for i in range(25)]
    parents = set(keys[:15])
    log = [(r.choice([*keys[5:20], None]), r.choice(["listed", "delisted", "moved"]), r.choice([*moments, None])) for _ in range(60)]
    log += log[:10]
    refs = [(r.choice(["s", "e"]), "3" if r.random() < 0.4 else r.choice([*keys, None]), r.choice([*moments, None])) for _ in range(900)]
    return parents, log, refs


def cases(parents, log, refs):
    states = ((t, f"{a:%Y-%m}", k, brute_state(k, a, parents, log)) for t, k, a in refs if k is not None and a is not None)
    return Counter(c for c in states if c[3] != "there")


PARENTS, LOG, REFS = "key string", "key string, action string, at timestamp_ntz", "table_name string, key string, at timestamp_ntz"


@pytest.mark.parametrize("per_part", [7, 1_000_000])
def test_orphans(spark, per_part):
    parents, log, refs = orphan_rows()
    timeline = parent_timeline(spark.createDataFrame([(p,) for p in [*parents, *parents]] + [(None,)], PARENTS), spark.createDataFrame(log, LOG))
    df = spark.createDataFrame(refs, REFS).withColumn("place2", F.lit(1))
    got = Counter(tuple(x) for x in reference_states(df, timeline, per_part).select("table_name", "key", "at", "state").collect())
    want = Counter((t, k, a, brute_state(k, a, parents, log)) for t, k, a in refs if k is not None and a is not None)
    assert got == want
    counts = orphan_counts(df.drop("place2"), timeline)
    assert {tuple(x)[:4]: x.n for x in counts.collect()} == dict(cases(parents, log, refs))
    snapshot = {tuple(x)[:3]: (x.n_rows, x.n_keys) for x in orphan_report(counts).collect()}
    cells = cases(parents, log, refs)
    assert sum(v[0] for v in snapshot.values()) == sum(cells.values()) and sum(v[1] for v in snapshot.values()) == len(cells)


@pytest.mark.parametrize("slices", [1, 3])
def test_replayed_state_equals_brute_force(spark, slices):
    parents, log, refs = orphan_rows(8)
    state = replay(spark.createDataFrame(refs, REFS), spark.createDataFrame([(p,) for p in parents], PARENTS), spark.createDataFrame(log, LOG), slices)
    assert {tuple(x)[:4]: x.n for x in state.counts().collect()} == dict(cases(parents, log, refs))


def test_state_resolves_and_reopens_in_any_order(spark):
    """Parents that are late, early, repeated or older than the last one: after each batch the state is that of all rows so far."""
    parents, log, refs = orphan_rows(11)
    r = random.Random(1)
    r.shuffle(log)
    state, seen_p, seen_l, seen_r = OrphanState(spark), set(), [], []
    changed = 0
    for i in range(4):
        p, g, f = sorted(parents)[i::4], [*log[i::4], *log[:3]], refs[i::4]
        before = cases(seen_p, seen_l, seen_r)
        seen_p |= {*p}
        seen_l += g
        after = cases(seen_p, seen_l, seen_r)
        changed += sum(before[c] != after[c] for c in {*before, *after})
        seen_r += f
        for _ in range(1 + (i == 2)):  # a batch that is repeated replaces itself
            state.advance(i, spark.createDataFrame(f, REFS), spark.createDataFrame([(x,) for x in p], PARENTS), spark.createDataFrame(g, LOG))
        assert {tuple(x)[:4]: x.n for x in state.counts().collect()} == dict(cases(seen_p, seen_l, seen_r))
    assert changed > 20


def test_orphans_empty(spark):
    none = spark.createDataFrame([], "key string")
    timeline = parent_timeline(none, spark.createDataFrame([], "key string, action string, at timestamp_ntz"))
    refs = spark.createDataFrame([("s", "1", T(2025, 1, 1))], "table_name string, key string, at timestamp_ntz")
    assert [tuple(x) for x in orphan_counts(refs, timeline).collect()] == [("s", "2025-01", "1", "missing", 1)]
    assert orphan_counts(refs.limit(0), timeline).collect() == []
    assert replay(refs.limit(0), none, spark.createDataFrame([], LOG)).counts().collect() == []
