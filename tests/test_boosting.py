"""Joint boosting against plain Python, its values, and the model queries' measures by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from failscope.operators import boosting, models


def brute_tree(rows, r, depth):
    """Exact regression tree as a function of a row; leaves are lists of row numbers."""
    def grow(at, depth):
        best = None
        for f in range(len(rows[0])) if depth else ():
            values = sorted({rows[i][f] for i in at})
            for a, b in zip(values, values[1:], strict=False):
                t = a + (b - a) / 2
                left = [i for i in at if rows[i][f] <= t]
                right = [i for i in at if rows[i][f] > t]
                means = [sum(r[i] for i in s) / len(s) for s in (left, right)]
                gain = len(left) * len(right) / len(at) * (means[0] - means[1]) ** 2
                if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = gain, f, t, left, right
        if best is None:
            return at
        return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)

    return grow(list(range(len(rows))), depth)


def leaf_of(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tuple(tree)


def brute_boosting(rows, labels, k, rounds, depth, rate):
    prior = [math.log(labels.count(c) / len(labels)) for c in range(k)]
    mean = sum(prior) / k
    raw = [[p - mean for p in prior] for _ in rows]
    model = []
    for _ in range(rounds):
        shares = []
        for s in raw:
            e = [math.exp(x - max(s)) for x in s]
            shares.append([x / sum(e) for x in e])
        trees = []
        for c in range(k):
            r = [(labels[i] == c) - shares[i][c] for i in range(len(rows))]
            tree, value = brute_tree(rows, r, depth), {}
            for i in range(len(rows)):
                leaf = leaf_of(tree, rows[i])
                h = sum(abs(r[j]) * (1 - abs(r[j])) for j in leaf)
                value[leaf] = (k - 1) / k * sum(r[j] for j in leaf) / h if abs(h) > 1e-150 else 0.0
            trees.append((tree, value))
        for i, row in enumerate(rows):
            for c, (tree, value) in enumerate(trees):
                raw[i][c] += rate * value[leaf_of(tree, row)]
        model.append(trees)
    return raw, model, [p - mean for p in prior]


def shares(raw):
    e = np.exp(np.array(raw) - np.max(raw, axis=1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def frame_of(spark, rows, labels, parts=3):
    data = [(i, float(y), x) for i, (x, y) in enumerate(zip(rows, labels, strict=True))]
    df = spark.createDataFrame(data, "i long, label double, v array<double>").repartition(parts)
    return df.select("i", "label", array_to_vector("v").alias("features"))


@pytest.fixture(scope="module")
def blobs():
    rng = random.Random(4)
    labels = [rng.randrange(3) for _ in range(60)]
    rows = [
        [round(rng.gauss(y, 1.2), 1), rng.choice([0.0, 0.0, 0.0, round(rng.random(), 2) * (y == 1) + 0.1]),
         -float(rng.randrange(4)), 0.0, float(y == 2 and rng.random() < 0.7), rng.gauss(0, 1)]
        for y in labels
    ]
    return rows, labels


@pytest.mark.parametrize("rounds,depth", [(1, 1), (12, 3), (11, 2)])
def test_joint_boosting_equals_plain_python(spark, blobs, rounds, depth, tmp_path):
    rows, labels = blobs
    df = frame_of(spark, rows, labels)
    model = boosting.fit(df, rounds, depth, 0.1)
    raw, trees, start = brute_boosting(rows, labels, 3, rounds, depth, 0.1)
    got = sorted(model.transform(df).select("i", vector_to_array("probability").alias("p"), "prediction").collect())
    want = shares(raw)
    assert np.abs(np.array([r["p"] for r in got]) - want).max() < 1e-6
    assert [r["prediction"] for r in got] == want.argmax(1).tolist()
    # Rows the fit has not seen, from beyond all bounds, without a number or between bounds.
    fresh = [[9.0, -3.0, 7.0, 1.0, 0.5, 0.0], [-9.0, 0.05, -1.5, 0.0, 0.0, 0.3]]
    PipelineModel([model]).write().overwrite().save(str(tmp_path))
    loaded = PipelineModel.load(str(tmp_path)).stages[0]
    unseen = sorted(loaded.transform(frame_of(spark, fresh, [0, 0])).select("i", vector_to_array("rawPrediction").alias("s")).collect())
    for row, r in zip(fresh, unseen, strict=True):
        s = list(start)
        for round_ in trees:
            for c, (tree, value) in enumerate(round_):
                s[c] += 0.1 * value[leaf_of(tree, row)]
        assert r["s"] == pytest.approx(s, abs=1e-6)


def test_boosting_of_odd_inputs(spark):
    same = frame_of(spark, [[0.0, 2.0]] * 6, [0, 0, 0, 1, 1, 1])
    p = [r["p"] for r in boosting.fit(same, 3).transform(same).select(vector_to_array("probability").alias("p")).collect()]
    assert np.abs(np.array(p) - 0.5).max() < 1e-9
    nan = frame_of(spark, [[float("nan")], [1.0], [2.0], [3.0]], [1, 0, 0, 0])
    model = boosting.fit(nan, 5, classes=3)
    got = sorted(model.transform(nan).select("i", "prediction", vector_to_array("probability").alias("p")).collect())
    # No number lies with the largest value; a class without rows gets nothing.
    assert got[0]["p"] == got[3]["p"] != got[2]["p"] and all(r["p"][2] < 1e-9 for r in got)
    with pytest.raises(ValueError):
        boosting.fit(nan.limit(0))


def test_many_values_are_cut_into_few_bins(spark):
    rng = random.Random(8)
    x = [rng.gauss(0, 1) for _ in range(3000)]
    df = frame_of(spark, [[v, 0.0 if i % 2 else v * v] for i, v in enumerate(x)], [int(v > 0.3) for v in x])
    bounds = boosting.bin_bounds(df, 3000)
    assert all(len(b) <= boosting.BINS + 1 for b in bounds.values()) and len(bounds) == 2
    model = boosting.fit(df, 20, 2)
    right = model.transform(df).filter("label = prediction").count()
    assert right > 2900


def test_a_level_is_one_pass_for_all_classes(spark, blobs):
    """Jobs of a fit grow with rounds and depth, not with classes."""
    rows, labels = blobs
    tracker = spark.sparkContext.statusTracker()

    def jobs(y):
        spark.sparkContext.setJobGroup(f"boost-{max(y)}", "")
        boosting.fit(frame_of(spark, rows, y), 2, 2)
        return len(tracker.getJobIdsForGroup(f"boost-{max(y)}"))

    try:
        assert jobs([y % 2 for y in labels]) == jobs([i % 6 for i in range(60)])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_vote_is_the_mean_of_both(spark, blobs):
    rows, labels = blobs
    df = frame_of(spark, rows, labels).withColumn("root_cause", F.lit("x"))
    boosted = boosting.fit(df.select("label", "features"), 3, 2)
    forest = models.train_random_forest(df.select("label", "features"), trees=3, depth=3, balanced=False)

    class Ready:  # features are there already
        def transform(self, df):
            return df

    both = [sorted(models.class_probabilities(m, df).select("i", "probabilities").collect()) for m in (boosted, forest)]
    voted = models.vote_ensemble(df, Ready(), [boosted, forest], ["a", "b", "c"])
    for r, a, b in zip(sorted(voted.select("i", "root_cause", "confidence", "all_probabilities").collect()), *both, strict=True):
        mean = (np.array(a["probabilities"]) + np.array(b["probabilities"])) / 2
        assert r["confidence"] == pytest.approx(mean.max(), abs=1e-4)
        assert r["root_cause"] == "abc"[int(mean.argmax())]
        assert [r["all_probabilities"][c] for c in "abc"] == pytest.approx(mean.round(4).tolist(), abs=1e-4)


def shares_of_leaf(tree, row):
    """Class shares of the leaf that a row falls into, by a walk over the tree's nodes."""
    node = tree._java_obj.rootNode()
    while node.getClass().getSimpleName() != "LeafNode":
        split = node.split()
        node = node.leftChild() if row[split.featureIndex()] <= split.threshold() else node.rightChild()
    stats = np.array(list(node.impurityStats().stats()))
    return stats / stats.sum()


def test_forest_scores_equal_a_walk_over_its_trees(spark, blobs):
    rows, labels = blobs
    df = frame_of(spark, rows, labels).withColumn("root_cause", F.lit("x"))
    forest = models.train_random_forest(df.select("label", "features"), trees=5, depth=3, balanced=True)

    class Ready:
        def transform(self, df):
            return df

    got = sorted(models.score_failures(df, Ready(), forest, classes=["a", "b", "c"]).select(
        "i", "root_cause", "confidence", "all_probabilities").collect())
    for row, r in zip(rows, got, strict=True):
        mean = np.mean([shares_of_leaf(t, row) for t in forest.trees], axis=0)
        assert [r["all_probabilities"][c] for c in "abc"] == pytest.approx(mean.round(4).tolist(), abs=1e-4)
        assert r["confidence"] == pytest.approx(mean.max(), abs=1e-4) and r["root_cause"] == "abc"[int(mean.argmax())]


def test_measures_are_those_of_counted_predictions(spark, blobs):
    from failscope.operators.training import report

    rows, labels = blobs
    df = frame_of(spark, rows, labels).withColumn("root_cause", F.get(F.array(*map(F.lit, "abc")), F.col("label").cast("int")))
    model = boosting.fit(df.select("label", "features"), 1, 1)
    guess = [int(r["prediction"]) for r in sorted(model.transform(df).select("i", "prediction").collect())]
    got = {(r["class"], r["metric"]): r["value"] for r in report(model, df, "m", ["a", "b", "c"]).collect()}
    assert got[(None, "accuracy")] == pytest.approx(np.mean([g == y for g, y in zip(guess, labels, strict=True)]), abs=1e-4)
    for k, name in enumerate("abc"):
        hit = sum(g == y == k for g, y in zip(guess, labels, strict=True))
        assert got[(name, "support")] == labels.count(k)
        assert got[(name, "recall")] == pytest.approx(hit / labels.count(k), abs=1e-4)
        assert got[(name, "precision")] == pytest.approx(hit / guess.count(k) if guess.count(k) else 0, abs=1e-4)


def test_scores_walk_the_trees_for_every_kind_of_vector(spark):
    """Sparse, dense, short, missing and not-a-number values against a plain walk."""
    import json

    from failscope.operators.boosting import BoostedClasses

    rng = np.random.default_rng(4)
    trees = [[{"feature": [int(rng.integers(-1, 9)) for _ in range(7)], "bound": [float(x) for x in rng.normal(size=7)],
               "value": [float(x) for x in rng.normal(size=8)]} for _ in range(3)] for _ in range(6)]
    state = {"depth": 3, "rate": 0.1, "start": [0.1, -0.2, 0.3], "trees": trees}
    rows = [rng.normal(size=9) * (rng.random(9) < 0.5) for _ in range(30)] + [np.array([np.nan] * 9), rng.normal(size=4)]
    vectors = [Vectors.dense(v) if i % 3 == 0 else Vectors.sparse(len(v), [j for j in range(len(v)) if v[j] != 0], [x for x in v if x != 0]) for i, v in enumerate(rows)]
    df = spark.createDataFrame(list(enumerate(vectors)), ["i", "features"]).coalesce(2)
    got = {r["i"]: r["rawPrediction"].toArray().tolist() for r in BoostedClasses(json.dumps(state)).transform(df).collect()}
    for i, v in enumerate(rows):
        want = list(state["start"])
        for round_ in trees:
            for c, t in enumerate(round_):
                at = 0
                for _ in range(3):
                    f = t["feature"][at]
                    at = 2 * at + 1 + int(0 <= f < len(v) and (np.isnan(v[f]) or v[f] > t["bound"][at]))
                want[c] += 0.1 * t["value"][at - 7]
        assert got[i] == pytest.approx(want)
