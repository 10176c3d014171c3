"""Boosted trees under several weightings at once, over rows cut into bins: for more rows than Spark's own trainer can keep in memory.

The rounds are those of Spark's GBTRegressor with absolute loss: the first tree is fitted to the target, each further one to the
sign of what is left, by variance, and counts for the rate; with validation rows boosting stops once their error falls by less
than the tolerance. What differs is how it is done: a row is a byte a feature, one pass gives a level of the trees of all
weightings, and split candidates come from all rows instead of a sample of ten thousand. Models are Spark's own objects."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.tables import settled

#: Bins of a feature; points that stand for its values where there are more; rows of a stored block, and of those handled at once.
BINS, POINTS, BLOCK, CHUNK = 32, 256, 1024, 32768


def squeezed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and their counts as POINTS values at most: the last ones of as many ranges of equal numbers of rows."""
    if len(values) <= POINTS:
        return values, counts
    ends = np.cumsum(counts)
    place = (ends - 1) * POINTS // ends[-1]
    last = np.flatnonzero(np.append(place[1:] != place[:-1], True))
    return values[last], np.diff(ends[last], prepend=0)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    counts = np.zeros(len(values), np.int64)
    np.add.at(counts, at, np.concatenate([c for _, c in parts]))
    return squeezed(values, counts)


def thresholds(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Up to BINS - 1 places between values: between any two of them if they are few, else a frequent value has a bin of its own and
    the others share the rest evenly."""
    between = values[:-1] + (values[1:] - values[:-1]) / 2
    if len(values) > BINS:
        heavy = counts * BINS >= counts.sum()
        share, held, ends = counts[~heavy].sum() / max(1, BINS - heavy.sum()), 0, []
        for i in range(len(values) - 1):
            held += counts[i]
            if heavy[i] or held >= share or heavy[i + 1] and held * 2 >= share:
                ends.append(i)
                held = 0
        between = between[ends[: BINS - 1]]
    return np.unique(between[np.isfinite(between)])


def candidates(df: DataFrame, names: list[str]) -> list[np.ndarray]:
    """The split candidates of each feature, from all rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        for b in batches:
            for j, own in enumerate(held):
                own.append(squeezed(*np.unique(b.column(j).to_numpy(zero_copy_only=False), return_counts=True)))
                if len(own) > 30:
                    own[:] = [merged(own)]
        done = [merged(own) for own in held if own]
        yield pa.RecordBatch.from_pydict({"feature": pa.array(range(len(done)), pa.int32()), "v": pa.array([v.tobytes() for v, _ in done], pa.binary()), "c": pa.array([c.astype(np.int64).tobytes() for _, c in done], pa.binary())})

    def joined(rows: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(v), np.frombuffer(c, np.int64)) for v, c in zip(rows["v"].to_pylist(), rows["c"].to_pylist())]
        return pa.table({"feature": rows["feature"].slice(0, 1), "cuts": pa.array([thresholds(*merged(parts)).tobytes()], pa.binary())})

    found = df.select(*names).mapInArrow(summed, "feature int, v binary, c binary").groupBy("feature").applyInArrow(joined, "feature int, cuts binary").collect()
    out = [np.empty(0)] * len(names)
    for r in found:
        out[r.feature] = np.frombuffer(r.cuts)
    return out


def blocks_of(df: DataFrame, names: list[str], cuts: list[np.ndarray], own: list[str], valid: str) -> DataFrame:
    """The rows as written blocks: valid, n, own (the columns own as doubles) and bins (a byte for each feature), column after column."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda j: b.column(j).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            bins = np.empty((len(names), b.num_rows), np.uint8)
            for j, c in enumerate(cuts):
                bins[j] = np.searchsorted(c, column(j))
            rest = np.stack([column(len(names) + j) for j in range(len(own))])
            flag = column(len(names) + len(own)).astype(bool)
            for v in (False, True):
                at = np.flatnonzero(flag == v)
                parts = [at[i : i + BLOCK] for i in range(0, len(at), BLOCK)]
                yield pa.RecordBatch.from_pydict({
                    "valid": pa.array([v] * len(parts), pa.bool_()), "n": pa.array([len(p) for p in parts], pa.int32()),
                    "own": pa.array([rest[:, p].tobytes() for p in parts], pa.binary()), "bins": pa.array([bins[:, p].tobytes() for p in parts], pa.binary()),
                })

    return settled(df.select(*names, *own, valid).mapInArrow(cut, "valid boolean, n int, own binary, bins binary"))


class Tree:
    """Nodes by their place in a heap: feature and last bin of the left side where a node is split, and [weight, sum, sum of squares]."""

    def __init__(self) -> None:
        self.splits: dict[int, tuple[int, int, float]] = {}
        self.sums: dict[int, np.ndarray] = {}

    def value(self, k: int) -> float:
        w, s, _ = self.sums[k]
        return float(s / w) if w > 0 else 0.0

    def flat(self) -> "Flat":
        values = np.zeros(max(self.sums, default=0) + 1)
        for k in self.sums:
            values[k] = self.value(k)
        return [(k, j, b) for k, (j, b, _) in sorted(self.splits.items())], values


#: What a task needs of a tree: its splits in the order of the heap and the nodes' values.
Flat = tuple[list[tuple[int, int, int]], np.ndarray]


def places(tree: Flat, bins: np.ndarray) -> np.ndarray:
    """Each row's node."""
    at = np.zeros(bins.shape[1], np.uint8)
    for k, j, b in tree[0]:
        at += (at == k) * ((bins[j] > b).view(np.uint8) + np.uint8(k + 1))
    return at


def predicted(forest: list[Flat], rate: float, bins: np.ndarray) -> np.ndarray:
    out = np.zeros(bins.shape[1])
    for m, tree in enumerate(forest):
        out += tree[1][places(tree, bins)] * (rate if m else 1.0)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Blocks put together: valid, own, bins."""
    held: dict[bool, list] = {False: [], True: []}

    def joined(v: bool) -> tuple[bool, np.ndarray, np.ndarray]:
        parts, held[v] = held[v], []
        return v, np.concatenate([p for p, _ in parts], axis=1), np.concatenate([p for _, p in parts], axis=1)

    for b in batches:
        for v, n, own, bins in zip(*(b.column(j).to_pylist() if j < 2 else b.column(j) for j in range(4))):
            held[v].append((np.frombuffer(own.as_buffer()).reshape(-1, n), np.frombuffer(bins.as_buffer(), np.uint8).reshape(width, n)))
            if sum(p.shape[1] for p, _ in held[v]) >= CHUNK:
                yield joined(v)
    yield from (joined(v) for v in held if held[v])


#: Number of the weight column, whether validation rows are fitted too, finished trees, growing tree, nodes whose sums are asked for.
Job = tuple[int, bool, list[Tree], Tree, list[int]]


def one_pass(blocks: DataFrame, width: int, jobs: list[Job], rate: float, splits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each job the sums of each node by feature and bin, as node, feature, bin, [weight, sum, sum of squares], and the weighted
    error of the validation rows that it doesn't fit, with their weight. splits: input splits of blocks."""
    small = [(column, whole, [t.flat() for t in forest], tree.flat(), nodes) for column, whole, forest, tree, nodes in jobs]
    shapes = [(width, 3 if not forest else 2, len(nodes), BINS) for *_, forest, _, nodes in jobs]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, errors = [np.zeros(s) for s in shapes], np.zeros((len(small), 2))
        for valid, own, bins in _chunks(batches, width):
            y = own[0]
            for i, (column, whole, forest, tree, nodes) in enumerate(small):
                w, so_far = own[column], predicted(forest, rate, bins)
                if valid and not whole:
                    errors[i] += (w * np.abs(y - so_far)).sum(), w.sum()
                    continue
                if not nodes:
                    continue
                slot_of = np.full(256, -1)
                slot_of[nodes] = range(len(nodes))
                slot, rows, kept = slot_of[places(tree, bins)], slice(None), bins
                if tree[0]:
                    rows = np.flatnonzero(slot >= 0)
                    kept = bins.take(rows, axis=1)
                slot, w, y_own = slot[rows], w[rows], y[rows]
                size = len(nodes) * BINS
                if forest:  # what is left is -1 or 1: a side for each, and their weights are all there is to sum
                    at = ((y_own >= so_far[rows]) * len(nodes) + slot) * BINS
                    for j in range(width):
                        sums[i][j] += np.bincount(at + kept[j], w, 2 * size).reshape(2, -1, BINS)
                else:
                    for k, x in enumerate((w, w * y_own, w * y_own * y_own)):
                        for j in range(width):
                            sums[i][j, k] += np.bincount(slot * BINS + kept[j], x, size).reshape(-1, BINS)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([b"".join(x.tobytes() for x in (*sums, errors))], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x.as_buffer()) for b in batches for x in b.column(0)]
        yield pa.RecordBatch.from_pydict({"sums": pa.array([sum(parts).tobytes()] if parts else [], pa.binary())})

    tasks, most = blocks.mapInArrow(summed, "sums binary"), 2 * blocks.sparkSession.sparkContext.defaultParallelism
    if splits > most:  # each split by itself, then added in a bounded number of tasks: that bounds what comes to the driver
        tasks = tasks.coalesce(most).mapInArrow(added, "sums binary")
    total = sum((np.frombuffer(r.sums) for r in tasks.collect()), np.zeros(sum(map(math.prod, shapes)) + 2 * len(jobs)))
    out, at = [], 0
    for (*_, forest, _, _), shape in zip(jobs, shapes):
        own = total[at : (at := at + math.prod(shape))].reshape(shape)
        if forest:
            weight = own[:, 0] + own[:, 1]
            own = np.stack([weight, own[:, 1] - own[:, 0], weight], axis=1)
        out.append(own.transpose(2, 0, 3, 1))
    return list(zip(out, total[at:].reshape(-1, 2)))


def best_split(sums: np.ndarray) -> tuple[int, int, float, np.ndarray, np.ndarray] | None:
    """Feature, last bin of the left side, gain and both sides' sums of the split that lowers the variance most; None if none does."""
    whole = sums[0].sum(axis=0)
    left = sums[:, :-1].cumsum(axis=1)
    right = whole - left
    a, b, least = left[..., 0], right[..., 0], 1e-12 * whole[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 1] ** 2 / a + right[..., 1] ** 2 / b - whole[1] ** 2 / whole[0]
    gain = np.where((a > least) & (b > least), gain, -np.inf) / whole[0] if whole[0] > 0 else np.zeros_like(a)
    j, k = np.unravel_index(int(gain.argmax()), gain.shape)
    spread = (whole[2] - whole[1] ** 2 / whole[0]) / whole[0] if whole[0] > 0 else 0.0
    return (int(j), int(k), float(gain[j, k]), left[j, k], right[j, k]) if gain[j, k] > 1e-12 * max(spread, 1e-12) else None


def boosted(blocks: DataFrame, width: int, columns: list[int], rounds: int, least: int, depth: int = 4, rate: float = 0.1, tolerance: float = 0.01) -> dict[int, tuple[list[Tree], list[Tree]]]:
    """For each weight column the trees fitted without the validation rows, as many as lower their error (rounds at most), and as
    many trees (least at the least) fitted to all rows. Both grow in the same passes: the first n trees are the same however many follow."""
    forests: dict[tuple[int, bool], list[Tree]] = {(k, whole): [] for k in columns for whole in (False, True)}
    best: dict[int, tuple[float, int]] = {}
    done: set[int] = set()
    splits = blocks.rdd.getNumPartitions()

    def goes_on(key: tuple[int, bool]) -> bool:
        k, whole = key
        if not whole:
            return k not in done
        return len(forests[key]) < max(least, best[k][1] if k in done else rounds)

    def judge(k: int, error: np.ndarray) -> None:
        now, n = float(error[0] / error[1]) if error[1] > 0 else 0.0, len(forests[k, False])
        if k in best and best[k][0] - now < tolerance * max(now, 0.01):
            done.add(k)
        elif k not in best or now < best[k][0]:
            best[k] = (now, n)
        if n == rounds:
            done.add(k)

    while going := [key for key in forests if goes_on(key)]:
        trees, known = {key: Tree() for key in going}, {}
        asked = {key: [0] if key[1] or len(forests[key]) < rounds else [] for key in going}
        for level in range(depth):
            jobs = [(*key, forests[key], trees[key], asked[key]) for key in going if asked[key] or not level]
            found = one_pass(blocks, width, jobs, rate, splits) if jobs else []
            for (k, whole, forest, _, _), (_, error) in zip(jobs, found):
                if not level and not whole and forest:
                    judge(k, error)
            going = [key for key in going if goes_on(key)]
            for (k, whole, _, tree, nodes), (sums, _) in zip(jobs, found):
                if (key := (k, whole)) not in going:
                    continue
                here = dict(zip(nodes, sums))
                for n in nodes if level else ():  # the other child is what is left of its parent
                    here[n + 1 if n % 2 else n - 1] = known[key][(n - 1) // 2] - here[n]
                asked[key], known[key] = [], here
                if not level:
                    tree.sums[0] = sums[0][0].sum(axis=0)
                for n, own in sorted(here.items()):
                    if split := best_split(own):
                        j, b, gain, left, right = split
                        tree.splits[n] = (j, b, gain)
                        tree.sums |= {2 * n + 1: left, 2 * n + 2: right}
                        asked[key].append(2 * n + 1 if left[0] <= right[0] else 2 * n + 2)
        for key in going:
            forests[key].append(trees[key])
    return {k: (forests[k, False][: best[k][1]], forests[k, True][: max(least, best[k][1])]) for k in columns}


def spark_model(spark: SparkSession, forest: list[Tree], cuts: list[np.ndarray], kept: list[int], width: int, rate: float = 0.1) -> GBTRegressionModel:
    """The trees as a model of Spark's library over width features, of which the bins had those in kept."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml = jvm.org.apache.spark.ml

    def node(tree: Tree, k: int) -> object:
        w, s, q = map(float, tree.sums[k])
        sums = gateway.new_array(jvm.double, 3)
        for i, x in enumerate((w, s, q)):
            sums[i] = x
        stats = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(sums, round(w))
        spread = max(0.0, q / w - (s / w) ** 2) if w > 0 else 0.0
        if k not in tree.splits:
            return ml.tree.LeafNode(tree.value(k), spread, stats)
        j, b, gain = tree.splits[k]
        return ml.tree.InternalNode(tree.value(k), spread, gain, node(tree, 2 * k + 1), node(tree, 2 * k + 2), ml.tree.ContinuousSplit(kept[j], float(cuts[j][b])), stats)

    name = ml.util.Identifiable.randomUID
    trees, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(forest)), gateway.new_array(jvm.double, len(forest))
    for m, tree in enumerate(forest):
        trees[m] = ml.regression.DecisionTreeRegressionModel(name("dtr"), node(tree, 0), width)
        weights[m] = rate if m else 1.0
    return GBTRegressionModel(ml.regression.GBTRegressionModel(name("gbtr"), trees, weights, width))


def fit_weighted(train: DataFrame, valid: DataFrame, names: list[str], weights: dict[str, "F.Column"], trees: int, least: int) -> dict[str, GBTRegressionModel]:
    """A model for each weight: its rounds are those after which the validation error stops falling, then it is fitted to all rows with
    as many (least at the least). train and valid have the features as doubles without nulls. Candidates see the features of both."""
    rows = train.withColumn("__valid", F.lit(False)).unionByName(valid.withColumn("__valid", F.lit(True)))
    found = candidates(rows, names)
    kept = [j for j, c in enumerate(found) if len(c)] or [0]  # what has one value can't be split
    cuts, own = [found[j] for j in kept], ["__y", *(f"__w{i}" for i in range(len(weights)))]
    rows = rows.select(*(names[j] for j in kept), F.col("target").cast("double").alias("__y"), *(w.cast("double").alias(n) for n, w in zip(own[1:], weights.values())), "__valid")
    blocks = blocks_of(rows, [names[j] for j in kept], cuts, own, "__valid")
    fitted = boosted(blocks, len(kept), list(range(1, len(own))), trees, least)
    return {mode: spark_model(train.sparkSession, last, cuts, kept, len(names)) for mode, (_, last) in zip(weights, fitted.values())}
