"""Gradient boosting of all classes together, on distributed histograms.

A round fits one regression tree per class to the residuals of the softmax over all classes, and
gives each leaf one Newton step, (K - 1) / K * sum(r) / sum(|r| (1 - |r|)). All K trees grow in the
same jobs: a level of all trees of a round is one pass over the rows, which sums residuals by
(class, node, feature, bin) inside the tasks, and one small grouping that picks the best split of
each node. Only these splits reach the driver.

Features are cut into bins at midpoints between distinct values, at most ``BINS`` + 2 of them, so
features with fewer values are split exactly. Rows keep the codes of bins that do not hold zero;
the zero bin is what is left of the node. Scores of the rows are written every ``WRITE_EVERY``
rounds; a task adds the trees since then.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut

BINS = 64
WRITE_EVERY = 10
MOST_PARTS = 64
BATCH_ROWS = 2_000
LEAST_WEIGHT = 1e-150
LEAST_PRIOR = 1e-15


class BoostedClasses(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Trees of all rounds. Adds rawPrediction, probability and prediction; a batch of rows walks the trees at once."""

    trees = Param(Params._dummy(), "trees", "the model as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, trees: str | None = None):
        super().__init__()
        if trees is not None:
            self._set(trees=trees)

    def state(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    def _transform(self, df: DataFrame) -> DataFrame:
        score = F.arrow_udf(raw_scores(self.state()), "array<double>")
        df = df.withColumn("_raw", score("features"))
        top = F.array_max("_raw")
        df = df.withColumn("_share", F.transform("_raw", lambda x: F.exp(x - top)))
        total = F.aggregate("_share", F.lit(0.0), lambda a, x: a + x)
        df = df.withColumn("_share", F.transform("_share", lambda x: x / total))
        best = F.array_position("_raw", F.array_max("_raw")) - 1
        return df.withColumns({
            "rawPrediction": array_to_vector("_raw"), "probability": array_to_vector("_share"), "prediction": best.cast("double"),
        }).drop("_raw", "_share")


def split_values(vectors: pa.StructArray, features: np.ndarray) -> np.ndarray:
    """Values of the features that trees split at, (row, feature), from vectors as Spark stores them.

    A feature that a row's vector is too short for, or that a missing vector lacks, leads left.
    """
    n = len(vectors)
    x = np.full((n, len(features)), -np.inf)
    kind, size, indices, values = (vectors.field(c) for c in ("type", "size", "indices", "values"))
    held = vectors.is_valid().to_numpy(zero_copy_only=False)
    sparse = held & (kind.fill_null(1).to_numpy(zero_copy_only=False) == 0)
    width = np.where(sparse, size.fill_null(0).to_numpy(zero_copy_only=False), 0)
    x[features[None, :] < width[:, None]] = 0.0
    flat = values.values.to_numpy(zero_copy_only=False)
    ends = values.offsets.to_numpy()
    for i in np.flatnonzero(held & ~sparse):
        own = flat[ends[i] : ends[i + 1]]
        known = features < len(own)
        x[i, known] = own[features[known]]
    if len(features) and sparse.any():
        at, ends_of = indices.values.to_numpy(zero_copy_only=False), indices.offsets.to_numpy()
        counts = np.where(sparse, np.diff(ends_of), 0)
        row = np.repeat(np.arange(n), counts)
        step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        feature = at[ends_of[:-1][row] + step]
        slot = np.minimum(np.searchsorted(features, feature), len(features) - 1)
        hit = features[slot] == feature
        x[row[hit], slot[hit]] = flat[ends[:-1][row] + step][hit]
    return x


def raw_scores(state: dict):
    """Arrow function: score per class, start value and the rate times the leaves that a vector falls into.

    Trees are complete: inner nodes in heap order, then leaves. A node without a split leads left,
    a value that is no number right. A batch takes each tree at once.
    """
    depth, rate, start = state["depth"], state["rate"], state["start"]
    used = sorted({f for trees in state["trees"] for t in trees for f in t["feature"] if f >= 0})
    features, place = np.array(used, dtype=np.int64), {f: i for i, f in enumerate(used)}
    coded = [
        [(np.array([place.get(f, -1) for f in t["feature"]]), np.array(t["bound"], float), np.array(t["value"], float)) for t in trees]
        for trees in state["trees"]
    ]

    def run(vectors: pa.Array) -> pa.Array:
        n = len(vectors)
        raw, rows = np.zeros((n, len(start))), np.arange(n)
        x = split_values(vectors, features)
        for trees in coded if len(features) else []:
            for c, (slot, bound, value) in enumerate(trees):
                at = np.zeros(n, dtype=np.int64)
                for _ in range(depth):
                    f = slot[at]
                    v = x[rows, f]
                    at = at * 2 + 1 + ((f >= 0) & ((v > bound[at]) | np.isnan(v)))
                raw[:, c] += rate * value[at - (2**depth - 1)]
        if not len(features):  # no tree splits: every row takes the first leaf
            for trees in coded:
                for c, (_, _, value) in enumerate(trees):
                    raw[:, c] += rate * value[0]
        raw = np.array(start) + raw
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(start), pa.int32()), pa.array(raw.ravel()))

    return run


# --- bins -------------------------------------------------------------------------------------

def bin_bounds(train: DataFrame, n_rows: int, bins: int = BINS) -> dict[int, list[float]]:
    """Split points by feature: midpoints between neighbouring values, ``bins`` + 1 at most.

    Reads non-zero values only; the result has at most features x bins numbers.
    """
    cells = train.select(F.posexplode(vector_to_array("features")).alias("feature", "value")).filter("value <> 0")
    values = cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(~F.isnan("value"), F.col("value"))
    points = F.percentile_approx(known, [i / bins for i in range(1, bins + 1)], 100 * bins)
    found = values.groupBy("feature").agg(points.alias("points"), F.min(known).alias("least"), F.sum("n").alias("n"))
    bounds = {}
    for r in found.collect():
        seen = {r["least"], *(r["points"] or ())} - {None} | ({0.0} if r["n"] < n_rows else set())
        order = sorted(seen)
        bounds[r["feature"]] = [a + (b - a) / 2 for a, b in zip(order, order[1:], strict=False)]
    return {f: b for f, b in bounds.items() if b}


class Bins:
    """Codes of (feature, bin) pairs: features one after the other, each with its bins."""

    def __init__(self, bounds: dict[int, list[float]]):
        self.features = sorted(bounds)
        self.bounds = [np.array(bounds[f]) for f in self.features]
        self.sizes = np.array([len(b) + 1 for b in self.bounds], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.zero = np.array([np.searchsorted(b, 0.0, side="left") for b in self.bounds], dtype=np.int64)
        self.n = int(self.starts[-1])

    def codes(self, rows: np.ndarray) -> list[np.ndarray]:
        """For each row, the codes of its bins that do not hold zero."""
        out = [[] for _ in rows]
        for i, f in enumerate(self.features):
            x = rows[:, f]
            # A value equal to a bound lies left of it; one that is no number, right of all.
            at = np.searchsorted(self.bounds[i], x, side="left")
            for r in np.flatnonzero(at != self.zero[i]):
                out[r].append(self.starts[i] + at[r])
        return [np.array(c, dtype=np.int32) for c in out]

    def table(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bins of all rows and features, row of each code, all codes)."""
        row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        flat = np.concatenate([*codes, np.empty(0, np.int32)]).astype(np.int64)
        feature = np.searchsorted(self.starts, flat, side="right") - 1
        x = np.tile(self.zero.astype(np.int16), (len(codes), 1))
        x[row, feature] = flat - self.starts[feature]
        return x, row, flat


def walk(tree: dict, x: np.ndarray, depth: int) -> np.ndarray:
    """Heap place of each row after ``depth`` levels."""
    at = np.zeros(len(x), dtype=np.int64)
    feature, split = np.array(tree["slot"]), np.array(tree["bin"])
    for _ in range(depth):
        f = feature[at]
        right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > split[at])
        at = 2 * at + 1 + right
    return at


def scores(base: np.ndarray, rounds: list, x: np.ndarray, depth: int, rate: float) -> np.ndarray:
    out = base.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += rate * np.array(tree["value"])[walk(tree, x, depth) - (2**depth - 1)]
    return out


def residuals(label: np.ndarray, raw: np.ndarray) -> np.ndarray:
    p = np.exp(raw - raw.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return (label[:, None] == np.arange(raw.shape[1])) - p


def batches_of(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            label, codes, raw = (part.column(i).to_pylist() for i in range(3))
            yield np.array(label), [np.array(c, np.int32) for c in codes], np.array(raw, dtype=float)


def level_sums(bins: Bins, rounds: list, growing: list, level: int, depth: int, rate: float):
    """Function for mapInArrow: a partition's sums by (class, node), as arrays over all codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, nodes = len(growing), 2**level
        sums, totals = np.zeros((3, k, nodes * bins.n)), np.zeros((3, k, nodes))
        for label, codes, base in batches_of(batches):
            x, row, flat = bins.table(codes)
            r = residuals(label, scores(base, rounds, x, depth, rate))
            for c in range(k):
                node = walk(growing[c], x, level) - (nodes - 1)
                of = (None, r[:, c], np.abs(r[:, c]) * (1 - np.abs(r[:, c])))
                for i, w in enumerate(of):
                    sums[i, c] += np.bincount(node[row] * bins.n + flat, None if w is None else w[row], nodes * bins.n)
                    totals[i, c] += np.bincount(node, w, nodes)
        sums = sums.reshape(3, k, nodes, bins.n)
        found = [(c, n) for c in range(k) for n in range(nodes) if totals[0, c, n]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int32()),
             pa.array([np.ascontiguousarray(sums[:, c, n]).tobytes() for c, n in found], pa.binary()),
             pa.array([totals[:, c, n].tobytes() for c, n in found], pa.binary())],
            names=["class", "node", "sums", "total"],
        )

    return run


def best_split(bins: Bins):
    """Function for one (class, node): its split of the largest gain, and what lies on both sides."""
    def run(table: pa.Table) -> pa.Table:
        add = lambda name: sum(np.frombuffer(b) for b in table.column(name).to_pylist())
        total = add("total")
        sums = add("sums").reshape(3, -1).copy()
        # The zero bin holds what the other bins of its feature do not.
        rest = total[:, None] - np.add.reduceat(sums, bins.starts[:-1], axis=1)
        sums[:, bins.starts[:-1] + bins.zero] += rest
        sums[0] = np.rint(sums[0])
        ends = np.cumsum(sums, axis=1)
        before = np.concatenate([np.zeros((3, 1)), ends], axis=1)[:, bins.starts[:-1]]
        left = ends - np.repeat(before, bins.sizes, axis=1)
        right = total[:, None] - left
        with np.errstate(all="ignore"):
            gain = left[0] * right[0] / total[0] * (left[1] / left[0] - right[1] / right[0]) ** 2
        last = np.zeros(bins.n, bool)
        last[bins.starts[1:] - 1] = True
        gain[last | (np.rint(left[0]) <= 0) | (np.rint(right[0]) <= 0) | ~np.isfinite(gain)] = 0
        most = gain.max()
        at, slot = -1, -1
        if most > 1e-12:
            # Sums come in any order; what differs in the last digits counts as a tie.
            at = int(np.argmax(np.round(gain / most, 9)))
            slot = int(np.searchsorted(bins.starts, at, side="right") - 1)
        side = (lambda s: s[:, at].tolist()) if at >= 0 else (lambda s: total.tolist())
        one = {"class": table.column("class")[0].as_py(), "node": table.column("node")[0].as_py(), "slot": slot,
               "bin": at - int(bins.starts[slot]) if at >= 0 else 0, "left": side(left), "right": side(right)}
        return pa.Table.from_pylist([one], schema=pa.schema([
            ("class", pa.int32()), ("node", pa.int32()), ("slot", pa.int32()), ("bin", pa.int32()),
            ("left", pa.list_(pa.float64())), ("right", pa.list_(pa.float64())),
        ]))

    return run


def leaf_value(side: list[float], classes: int) -> float:
    _, r, h = side
    return 0.0 if abs(h) < LEAST_WEIGHT else (classes - 1) / classes * r / h


def grow(data: DataFrame, bins: Bins, rounds: list, classes: int, depth: int, rate: float) -> list[dict]:
    """One tree per class, level by level."""
    inner = 2**depth - 1
    trees = [{"slot": [-1] * inner, "bin": [0] * inner, "value": [0.0] * 2**depth} for _ in range(classes)]
    for level in range(depth):
        found = (
            data.mapInArrow(level_sums(bins, rounds, trees, level, depth, rate), "class int, node int, sums binary, total binary")
            .groupBy("class", "node")
            .applyInArrow(best_split(bins), "class int, node int, slot int, bin int, left array<double>, right array<double>")
            .collect()
        )
        for r in found:
            tree, at = trees[r["class"]], 2**level - 1 + r["node"]
            tree["slot"][at], tree["bin"][at] = r["slot"], r["bin"]
            if level == depth - 1:
                place = 2 * r["node"]
                tree["value"][place] = leaf_value(r["left"], classes)
                tree["value"][place + 1] = leaf_value(r["right"], classes)
    return trees


def fit(train: DataFrame, rounds: int = 50, depth: int = 3, rate: float = 0.1, classes: int | None = None, bins: int = BINS) -> BoostedClasses:
    """Boost (label, features) rows. ``train`` is the bounded side of a training set."""
    counts = {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}  # one row per class
    n = sum(counts.values())
    if not n:
        raise ValueError("no rows to fit on")
    classes = classes or max(counts) + 1
    prior = np.log([max(counts.get(k, 0) / n, LEAST_PRIOR) for k in range(classes)])
    start = (prior - prior.mean()).tolist()
    bounds = bin_bounds(train, n, bins)
    state = {"depth": depth, "rate": rate, "start": start, "trees": []}
    if not bounds:
        return BoostedClasses(json.dumps(state))
    coded = Bins(bounds)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                rows = np.array(part.column(1).to_pylist(), dtype=float)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(coded.codes(rows), pa.list_(pa.int32())),
                     pa.array([start] * part.num_rows, pa.list_(pa.float64()))], names=["label", "codes", "raw"],
                )

    schema = "label double, codes array<int>, raw array<double>"
    parts = min(MOST_PARTS, train.sparkSession.sparkContext.defaultParallelism)
    pairs = train.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("v"))
    data = cut(pairs.repartition(parts).mapInArrow(encode, schema), "boosting").persist()
    done: list[list[dict]] = []
    since: list[list[dict]] = []
    for i in range(rounds):
        trees = grow(data, coded, since, classes, depth, rate)
        since = [*since, trees]
        done.append(trees)
        if len(since) == WRITE_EVERY and i + 1 < rounds:
            def add(batches: Iterator[pa.RecordBatch], since=since) -> Iterator[pa.RecordBatch]:
                for label, codes, base in batches_of(batches):
                    raw = scores(base, since, coded.table(codes)[0], depth, rate)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(label), pa.array(codes, pa.list_(pa.int32())), pa.array(list(raw), pa.list_(pa.float64()))],
                        names=["label", "codes", "raw"],
                    )

            written = cut(data.mapInArrow(add, schema), "boosting").persist()
            data.unpersist()
            data, since = written, []
    data.unpersist()

    def plain(tree: dict) -> dict:
        slots = tree["slot"]
        return {
            "feature": [coded.features[s] if s >= 0 else -1 for s in slots],
            "bound": [float(coded.bounds[s][b]) if s >= 0 else 0.0 for s, b in zip(slots, tree["bin"], strict=True)],
            "value": [float(v) for v in tree["value"]],
        }

    state["trees"] = [[plain(t) for t in trees] for trees in done]
    return BoostedClasses(json.dumps(state))
