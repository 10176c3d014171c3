"""Mixtures of sources with target shares of all tokens: balanced sampling by the cube method."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.tables import settled

EDGE = 1e-9
#: Rows of the target table that the driver reads; a longer one is refused.
MOST_SOURCES = 10_000
#: Blocks that a task flies one after the other.
BLOCKS_PER_TASK = 4


def _step(p: np.ndarray, at: np.ndarray, u: np.ndarray, rng: np.random.Generator) -> None:
    """Moves p[at] along u or against it, until one is 0 or 1; the chances are such that expectations stay."""
    room_up = np.where(u > 0, 1 - p[at], p[at]) / np.maximum(np.abs(u), 1e-300)
    room_down = np.where(u > 0, p[at], 1 - p[at]) / np.maximum(np.abs(u), 1e-300)
    up, down = room_up[u != 0].min(), room_down[u != 0].min()
    p[at] += (up if rng.random() * (up + down) < down else -down) * u


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, large: float = 4.0) -> np.ndarray:
    """Moves inclusion probabilities until at most two are fractional, keeping sum(p) and sum(p*size) as they are.

    Each step goes along a vector in the null space of the constraints (sizes; ones). Units of more than large times the
    mean size come first, along the projection of their own axis, which spreads their move over all fractional units:
    left to the end, one of them could spoil the total. The others follow from large to small, three at a
    time, along the cross product of their constraints.
    """
    p = p.astype(float).copy()
    open_now = np.flatnonzero((p > EDGE) & (p < 1 - EDGE))
    if not len(open_now):
        return np.round(p)
    order = open_now[np.argsort(-size[open_now], kind="stable")]
    for g in order[size[order] > large * size[open_now].mean()].tolist():
        while EDGE < p[g] < 1 - EDGE:
            at = order[(p[order] > EDGE) & (p[order] < 1 - EDGE)]
            centred = size[at] - size[at].mean()
            spread = centred @ centred
            if len(at) < 3 or spread <= EDGE:
                break
            u = (at == g) - 1.0 / len(at) - centred * (centred[at == g][0] / spread)
            if abs(u[at == g][0]) < EDGE:
                break
            u[np.abs(u) < 1e-15] = 0.0
            _step(p, at, u, rng)
    held: list[int] = []
    for k in order.tolist():
        if not EDGE < p[k] < 1 - EDGE:
            continue
        held.append(k)
        while len(held) == 3:
            a, b, c = (float(size[i]) for i in held)
            u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
            up = down = np.inf
            for i, d in zip(held, u):
                if d > 0:
                    up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
                elif d < 0:
                    up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
            step = up if rng.random() * (up + down) < down else -down
            for i, d in zip(held, u):
                p[i] += step * d
            held = [i for i in held if EDGE < p[i] < 1 - EDGE]
    near = (p <= EDGE) | (p >= 1 - EDGE)
    p[near] = np.round(p[near])
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles the few units left: of all their roundings the one nearest in size, then in number."""
    left = np.flatnonzero((p > EDGE) & (p < 1 - EDGE))
    if not len(left):
        return p
    choices = np.array(np.meshgrid(*[[0.0, 1.0]] * len(left))).reshape(len(left), -1).T
    off = np.abs(choices @ size[left] - p[left] @ size[left])
    best = np.lexsort((np.abs(choices.sum(1) - p[left].sum()), off))[0]
    p = p.copy()
    p[left] = choices[best]
    return p


def plan_shares(targets: list[tuple[str, float, int]], tokens: dict[str, int], total_tokens: float | None = None) -> dict[str, tuple[float, float]]:
    """source -> (share, expected uses of each document). Sources without tokens drop out and their share goes to
    the others in proportion. Without total_tokens the mixture is the largest in which every source
    reaches its share within its max_repeats; with it, sources that lack tokens give all they may."""
    there = {s: (share, most) for s, share, most in targets if share > 0 and most > 0 and tokens.get(s, 0) > 0}
    whole = sum(share for share, _ in there.values())
    if not there:
        return {}
    total = min(tokens[s] * most * whole / share for s, (share, most) in there.items()) if total_tokens is None else total_tokens
    return {s: (share / whole, min(float(most), share / whole * total / tokens[s])) for s, (share, most) in there.items()}


def _flier(seed: int, level: int, last: bool):
    def fly(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["doc_id", "n_tokens"], kind="stable").reset_index(drop=True)
        sizes = t["n_tokens"].to_numpy(float)
        p = flight(t["p"].to_numpy(), sizes, np.random.default_rng([seed, level, int(key[1]), *str(key[0]).encode()]))
        t["p"] = landing(p, sizes) if last else p
        return t[["doc_id", "source", "n_tokens", "__whole", "p"]]

    return fly


def mixture(
    sized: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 42, block_rows: int = 4096,
) -> DataFrame:
    """Each row of sized (doc_id, source, n_tokens) whose source is in targets (source, target_share, max_repeats)
    with copies: how often the mixture uses it, 0 to max_repeats.

    Every document of a source is expected equally often: the whole part of that number is given to all, the
    fraction is an inclusion probability. The cube method turns it into 0 or 1 with totals of tokens and documents
    kept: flights in blocks of about block_rows rows (a hot source is just more blocks) leave at most two open rows a block,
    these fly again together, until one block for each source lands its last two.

    Null, blank-named or unlisted sources are left out unless targets lists them; targets with a null source,
    share or cap, or with repeated sources (all but the first by share and cap) are ignored; documents without tokens take
    part like others; null token counts count as 0. Same data and seed, same result. Empty tables give no rows.
    """
    spark = sized.sparkSession
    listed = targets.dropna(subset=["source", "target_share", "max_repeats"]).groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t"))
    wanted = [(r.source, r.t.target_share, r.t.max_repeats) for r in listed.limit(MOST_SOURCES + 1).collect()]
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = spark.createDataFrame([(w[0],) for w in wanted], "source string")
    rows = settled(sized.join(F.broadcast(names), "source", "left_semi").select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")))
    sums = {r.source: (r.n, r.t) for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    uses = plan_shares(wanted, {s: t for s, (_, t) in sums.items()}, total_tokens)
    fixed = [(s, int(np.floor(uses.get(s, (0, 0.0))[1] + EDGE)), uses.get(s, (0, 0.0))[1]) for s in sums]
    share = spark.createDataFrame([(s, whole, max(0.0, use - whole)) for s, whole, use in fixed], "source string, __whole int, __p double")
    state = rows.join(F.broadcast(share), "source").select("doc_id", "source", "n_tokens", "__whole", F.col("__p").alias("p"))
    blocks = {s: max(1, -(-n // block_rows)) for s, (n, _) in sums.items()}
    done, level = [], 0
    while True:
        size = spark.createDataFrame([(s, n) for s, n in blocks.items()] or [("", 1)], "source string, __blocks int")
        last = all(n == 1 for n in blocks.values())
        placed = state.join(F.broadcast(size), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", "n_tokens", F.lit(level)), F.col("__blocks")).cast("int")).drop("__blocks")

        # the number of tasks follows the blocks: by bytes, few small rows would all fly in one
        placed = placed.repartition(max(1, -(-sum(blocks.values()) // BLOCKS_PER_TASK)), "source", "block")
        flown = placed.groupBy("source", "block").applyInPandas(_flier(seed, level, last), "doc_id bigint, source string, n_tokens bigint, __whole int, p double")
        if last:
            done.append(flown)
            break
        flown = settled(flown)
        open_now = (F.col("p") > EDGE) & (F.col("p") < 1 - EDGE)
        done.append(flown.where(~open_now))
        state, level = flown.where(open_now), level + 1
        blocks = {s: max(1, -(-2 * n // block_rows)) if n > 1 else 1 for s, n in blocks.items()}
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "n_tokens", (F.col("__whole") + F.round("p").cast("int")).alias("copies"))


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target source: its documents, tokens and copies in the mixture, and the share it really reaches
    (null if the mixture is empty). A listed source without documents has zeros."""
    per = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.sum("copies").alias("n_copies"),
        F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"),
    )
    zero = ["n_documents", "n_tokens", "n_copies", "used_tokens", "most_copies"]
    joined = targets.join(per, "source", "left").fillna(0, zero)
    joined = joined.withColumn("__total", F.sum("used_tokens").over(Window.partitionBy(F.lit(0))))  # a row per target
    return joined.select("source", "target_share", "max_repeats", *zero, F.try_divide(F.col("used_tokens").cast("double"), F.col("__total")).alias("reached_share"))
