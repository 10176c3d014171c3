import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm.mixture import flight, landing, mixture, plan_shares, reached_shares


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_totals(seed):
    rng = np.random.default_rng(seed)
    p, size = rng.uniform(0, 1, 400), rng.integers(0, 900, 400).astype(float)
    size[:3] = 6000
    out = flight(p, size, rng)
    open_now = (out > 1e-9) & (out < 1 - 1e-9)
    assert open_now.sum() <= 2 and out.sum() == pytest.approx(p.sum(), abs=1e-6) and out @ size == pytest.approx(p @ size, rel=1e-6)
    landed = landing(out, size)
    assert set(landed.tolist()) <= {0.0, 1.0} and abs(landed @ size - p @ size) <= 900


def test_flight_keeps_expectations():
    p, size = np.array([0.2, 0.5, 0.3, 0.7, 0.9, 0.4]), np.array([3.0, 5.0, 8.0, 1.0, 2.0, 90.0])
    mean = np.mean([flight(p, size, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_flight_edges():
    rng = np.random.default_rng(0)
    assert flight(np.array([]), np.array([]), rng).tolist() == [] and flight(np.array([0.0, 1.0]), np.array([1.0, 1.0]), rng).tolist() == [0.0, 1.0]
    assert flight(np.full(6, 0.5), np.zeros(6), rng).sum() == pytest.approx(3)


def test_plan_shares():
    plan = plan_shares([("a", 0.5, 1), ("b", 0.3, 2), ("none", 0.2, 3)], {"a": 1000, "b": 100})
    assert set(plan) == {"a", "b"} and plan["b"][1] == pytest.approx(2) and plan["a"][1] * 1000 == pytest.approx(200 / 0.375 * 0.625)
    assert plan_shares([("a", 1.0, 1)], {}) == {}
    assert plan_shares([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 100, "b": 100}, 1000)["a"][1] == 1.0


def rows(n=3000, seed=2):
    rng = np.random.default_rng(seed)
    kinds = rng.choice(["hot", "mid", "small", "odd"], n, p=[0.6, 0.3, 0.05, 0.05])
    return [(i, str(k), int(s)) for i, (k, s) in enumerate(zip(kinds, rng.integers(1, 400, n)))] + [(n, None, 5), (n + 1, "mid", None), (None, "mid", 7), (n + 2, "mid", 0)]


TARGETS = [("hot", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 9)]


@pytest.mark.parametrize("block", [64, 4096])
def test_mixture_reaches_shares(spark, block):
    df = spark.createDataFrame(rows(), "doc_id bigint, source string, n_tokens bigint").withColumn("p", F.lit(1))
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixture(df, targets, block_rows=block)
    got = mixed.collect()
    assert len(got) == sum(r[1] in ("hot", "mid", "small") for r in rows())
    most = {s: m for s, _, m in TARGETS}
    assert all(0 <= r.copies <= most[r.source] for r in got)
    shares = {r.source: r for r in reached_shares(mixed, targets).collect()}
    for s, share, _ in TARGETS[:3]:
        assert shares[s].reached_share == pytest.approx(share / 0.9, abs=0.004)
    assert shares["absent"].used_tokens == 0 and shares["absent"].reached_share == 0.0
    again = {(r.doc_id, r.n_tokens): r.copies for r in mixture(df.orderBy(F.rand()), targets, block_rows=block).collect()}
    assert again == {(r.doc_id, r.n_tokens): r.copies for r in got}


def test_mixture_edges(spark):
    df = spark.createDataFrame(rows(50), "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mixture(df.limit(0), targets).collect() == [] and mixture(df, targets.limit(0)).collect() == []
    nothing = reached_shares(mixture(df.limit(0), targets), targets).collect()
    assert len(nothing) == 4 and all(r.reached_share is None for r in nothing)
    zero = spark.createDataFrame([(1, "hot", 0)], "doc_id bigint, source string, n_tokens bigint")
    assert [r.copies for r in mixture(zero, targets).collect()] == [0]


def test_blocks_fly_in_several_tasks(spark, monkeypatch):
    from tallyforge.llm import mixture as X

    seen, settle = [], X.settled
    monkeypatch.setattr(X, "settled", lambda df: seen.append(df) or settle(df))
    df = spark.createDataFrame(rows(), "doc_id bigint, source string, n_tokens bigint")
    mixture(df, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"), block_rows=64)
    assert seen[1].rdd.getNumPartitions() >= 10
