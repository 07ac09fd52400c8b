"""Sampling, features, neighbours and models."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from failscope.functions import vocab
from failscope.operators import features, models, oversample, sampling
from failscope.operators.clean import label_noise
from failscope.operators.training import TrainingSet, report, train_classifier
from failscope.plans.views import view


@pytest.fixture(scope="module")
def skewed(spark):
    """One label holds most rows."""
    rows = spark.range(3000).select(
        F.concat(F.lit("k"), "id").alias("k"),
        F.expr("case when id % 10 < 8 then 'hot' when id % 10 = 8 then 'warm' else concat('c', id % 3) end").alias("g"),
    ).cache()
    yield rows
    rows.unpersist()


@pytest.mark.parametrize("cap", [0, 1, 137, 2000, 5000])
def test_cap_is_the_lowest_draws(skewed, cap):
    want = {}
    for r in skewed.collect():
        want.setdefault(r["g"], []).append((hashlib.md5(f"cap:{r['k']}".encode()).hexdigest(), r["k"]))
    want = {k for rows in want.values() for _, k in sorted(rows)[:cap]}
    assert {r["k"] for r in sampling.cap_per_class(skewed, "g", "k", cap).collect()} == want
    few = sampling.cap_per_class(skewed, "g", "k", cap, classes=["hot"]).collect()
    assert {r["k"] for r in few} <= want and len(few) == min(cap, 2400)


def test_split_sizes(skewed):
    split = sampling.stratified_split(skewed, "g", "k")
    assert split.count() == 3000
    sizes = {r["g"]: r for r in split.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "test").alias("t")).collect()}
    for r in sizes.values():
        assert r["t"] == math.floor(r["n"] * 0.2 + 0.5)
    loose = sampling.stratified_split(skewed, "g", "k", exact=False)
    assert 500 < loose.filter("side = 'test'").count() < 700


def test_noise_keeps_most_labels(spark):
    df = spark.range(5000).select(F.col("id").alias("test_id"), F.lit("locator_issue").alias("root_cause"))
    counts = {r["root_cause"]: r["count"] for r in label_noise(df).groupBy("root_cause").count().collect()}
    assert 4400 < counts["locator_issue"] < 4600 and set(counts) == set(vocab.ROOT_CAUSES)


def test_terms_and_weights_by_hand(spark):
    df = spark.createDataFrame([(1, "Aa bb aa, x"), (2, "bb cc"), (3, "")], "d int, t string")
    counts = features.term_counts(features.tokenize_terms(df, "t"), "d")
    assert {(r["d"], r["term"]): r["tf"] for r in counts.collect()} == {
        (1, "aa"): 2, (1, "bb"): 1, (1, "aa bb"): 1, (1, "bb aa"): 1, (2, "bb"): 1, (2, "cc"): 1, (2, "bb cc"): 1,
    }
    got = {(r["d"], r["term"]): r["weight"] for r in features.tfidf(df, "d", "t", 2, bigrams=False).collect()}
    idf = {t: math.log(4 / (1 + n)) + 1 for t, n in (("aa", 1), ("bb", 2))}
    a, b = (1 + math.log(2)) * idf["aa"], idf["bb"]
    assert got[(1, "aa")] == pytest.approx(a / math.hypot(a, b)) and got[(2, "bb")] == pytest.approx(1.0)
    assert len(got) == 3


@pytest.mark.parametrize("k,tracked", [(3, 4), (20, 40), (20, 20), (500, 50), (1, 1)])
def test_vocabulary_from_sketches_is_exact(spark, k, tracked):
    """Zipf-like and flat counts, with ties at the k-th place, from sketches too small at first."""
    rng = np.random.default_rng(6)
    texts = [[f"t{min(int(x), 3000)}" for x in rng.zipf(1.4, 40)] for _ in range(300)] + [[f"u{i}", f"u{i + 1}"] for i in range(0, 400, 2)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, []), (-2, None)], "d long, terms array<string>").repartition(5)
    total, held = {}, {}
    for terms in texts:
        for t in terms:
            total[t] = total.get(t, 0) + 1
        for t in set(terms):
            held[t] = held.get(t, 0) + 1
    want = sorted(((-n, t) for t, n in total.items()))[:k]
    got = features.vocabulary(df, "d", k, tracked=tracked).collect()
    assert [(r["term"], r["total"], r["df"]) for r in got] == [(t, -n, held[t]) for n, t in want]
    assert features.vocabulary(df.filter("d < 0"), "d", k).collect() == []


def test_vocabulary_shuffles_sketches_not_terms(spark):
    """Ten times as many distinct terms, as many shuffled rows."""
    from failscope.operators.features import candidate_terms

    def names(rare):
        rows = [(i, ["often"] * 20 + ["more often"] * 40 + [f"r{i}-{j}" for j in range(rare)]) for i in range(200)]
        return {r["item"] for r in candidate_terms(spark.createDataFrame(rows, "d long, terms array<string>").repartition(4), "terms", 64)}

    assert all({"often", "more often"} <= names(n) and len(names(n)) <= 64 for n in (5, 50))


def test_vector_form_equals_long_form(spark, data_dir):
    docs = view(spark, data_dir, "failures_src").select("test_id", "error_message")
    stages = models.text_stages(docs, "test_id", "error_message", 40)
    vectors = docs
    for s in stages:
        vectors = s.transform(vectors)
    names = stages[2].vocabulary
    long_form = features.tfidf(docs, "test_id", "error_message", 40)
    want = {(r["test_id"], r["term"]): r["weight"] for r in long_form.collect()}
    got = {}
    for r in vectors.select("test_id", vector_to_array("error_message_tfidf").alias("v")).collect():
        got.update({(r["test_id"], t): w for t, w in zip(names, r["v"]) if w})
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("block,cell", [(7, 250), (50, 10), (2000, 3), (3, 1)])
def test_neighbours_for_any_block_size(spark, block, cell):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(120, 4)).round(1)
    points[100:110] = points[0]  # copies
    labels = ["a" if i % 4 else "b" for i in range(120)]
    df = spark.createDataFrame([(i, labels[i], points[i].tolist()) for i in range(120)], "k long, g string, v array<double>")
    got = {}
    for r in oversample.knn_within_class(df, "g", "k", "v", 3, block, cell_rows=cell).collect():
        got.setdefault(r["k"], []).append((r["rank"], r["neighbor"], round(r["distance"], 9)))
    for i in range(120):
        d = sorted((round(float(np.sqrt(((points[i] - points[j]) ** 2).sum())), 9), j) for j in range(120) if j != i and labels[j] == labels[i])
        assert [x[1:] for x in sorted(got[i])] == [(j, x) for x, j in d[:3]]


def test_few_cells_are_visited(spark, monkeypatch):
    """20,000 rows of one class, a fifth of them alike: exact for a sample, below a fifth of all pairs."""
    rng = np.random.default_rng(2)
    n = 20_000
    points = np.concatenate([rng.normal(size=(n * 4 // 5, 3)), np.tile([[0.5, 0.5, 0.5]], (n // 5, 1))])
    df = spark.createDataFrame([(i, "a", p.tolist(), i % 7 == 0) for i, p in enumerate(points)], "k long, g string, v array<double>, q boolean")
    seen = []
    plain = oversample.compare

    def counted(queries, candidates, *rest):
        a = queries.groupBy("_cell").agg(F.count("*").alias("nq"))
        seen.append(a.join(candidates.groupBy("_cell").agg(F.count("*").alias("nc")), "_cell").agg(F.sum(F.col("nq") * F.col("nc"))).first()[0])
        return plain(queries, candidates, *rest)

    monkeypatch.setattr(oversample, "compare", counted)
    got = {}
    for r in oversample.knn_within_class(df, "g", "k", "v", 4, asks="q").collect():
        got.setdefault(r["k"], []).append((r["rank"], r["neighbor"]))
    asked = range(0, n, 7)
    assert sorted(got) == list(asked) and len(seen) == 2 and seen[1] > 0
    assert sum(seen) < len(asked) * n / 5
    for i in [*range(0, n, 7 * 31), n * 4 // 5 + 5 - (n * 4 // 5 + 5) % 7]:
        d = np.sqrt(((points[i] - points) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [j for _, j in sorted(got[i])] == np.argsort(d, kind="stable")[:4].tolist()


def test_smote_levels_the_classes(spark):
    rows = [(i, "a", [float(i), 0.0]) for i in range(40)] + [(100 + i, "b", [float(i), 1.0]) for i in range(7)]
    df = spark.createDataFrame(rows, "k long, g string, v array<double>")
    made = oversample.smote(df, "g", "k", "v").collect()
    assert len(made) == 33 and {r["g"] for r in made} == {"b"}
    assert all(0.0 <= r["vector"][0] <= 6.0 and r["vector"][1] == 1.0 for r in made)
    assert len({(r["base"], r["copy"]) for r in made}) == 33
    assert oversample.smote(df, "g", "k", "v", threshold=7).count() == 0
    alone = spark.createDataFrame(rows[:40] + [(100, "b", [0.0, 1.0])], "k long, g string, v array<double>")
    assert oversample.smote(alone, "g", "k", "v").count() == 0


@pytest.fixture(scope="module")
def training(spark, data_dir):
    data = TrainingSet(view(spark, data_dir, "failures_src"))
    yield data
    data.release()


def test_forest_beats_the_majority_and_survives_saving(spark, data_dir, training, tmp_path):
    forest = models.train_random_forest(training.train, trees=10, depth=6)
    rows = {(r["class"], r["metric"]): r["value"] for r in report(forest, training.test(), "m").collect()}
    assert rows[(None, "macro_f1")] > 0.5
    models.save_model(training.stages, forest, str(tmp_path))
    stages, loaded = models.load_model(str(tmp_path))
    source = view(spark, data_dir, "failures_src")
    a = models.score_failures(source, training.stages, forest)
    b = models.score_failures(source, stages, loaded)
    pick = ["test_id", "root_cause", "confidence", F.to_json("all_probabilities").alias("p")]
    assert a.select(*pick).exceptAll(b.select(*pick)).count() == 0
    total = F.aggregate(F.map_values("all_probabilities"), F.lit(0.0), lambda x, y: x + y)
    assert a.filter(F.abs(total - 1.0) > 1e-3).count() == 0


def test_boosted_probabilities_and_vote(spark, data_dir, training):
    forest = models.train_random_forest(training.train, trees=5, depth=4)
    boosted = models.train_gradient_boosting(training.train, rounds=2)
    voted = models.vote_ensemble(training.test_rows, training.stages, [forest, boosted])
    total = F.aggregate(F.map_values("all_probabilities"), F.lit(0.0), lambda x, y: x + y)
    row = voted.agg(F.max(F.abs(total - 1.0)).alias("off"), F.count("*").alias("n")).first()
    assert row["off"] < 1e-3 and row["n"] == training.test_rows.count()


def test_whole_training_flow(spark, data_dir, tmp_path):
    done = train_classifier(view(spark, data_dir, "failures_src"), str(tmp_path), trees=5, depth=4, rounds=2)
    assert done.name in ("RandomForest", "GradientBoosting")
    assert {r["model"] for r in done.metrics.collect()} == {"RandomForest", "GradientBoosting"}
    stages, model = models.load_model(f"{tmp_path}/model")
    assert models.score_failures(view(spark, data_dir, "failures_src"), stages, model, done.name).count() == 1000


def test_unseen_categories_get_minus_one(spark):
    train = spark.createDataFrame([("b",), ("a",)], "c_given string")
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c_given string")
    for stage in models.category_stages(train, ["c"]):
        df = stage.transform(df)
    assert [r["c_code"] for r in df.collect()] == [0.0, 1.0, -1.0, -1.0]


@pytest.mark.parametrize("k,bigrams,listed", [(3, True, 20_000), (40, True, 20_000), (1, True, 20_000), (40, False, 20_000), (700, True, 5), (9, False, 5), (5000, True, 20_000)])
def test_vocabulary_from_frequent_words_is_exact(spark, monkeypatch, k, bigrams, listed):
    """Zipf-like texts, ties at the k-th place, rows that share a key, empty and missing texts."""
    monkeypatch.setattr(features, "MOST_LISTED", listed)
    rng = np.random.default_rng(8)
    texts = [[f"w{min(int(x), 900)}" for x in rng.zipf(1.5, 30)] for _ in range(150)] + [["it's", f"u{i}"] for i in range(60)] + [[], ["only"]]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(None, None)], "d long, _words array<string>").repartition(4)
    total, held = {}, {}
    for words in texts:
        own = words + [f"{a} {b}" for a, b in zip(words, words[1:]) if bigrams]
        for t in own:
            total[t] = total.get(t, 0) + 1
        for t in set(own):
            held[t] = held.get(t, 0) + 1
    want = sorted((-n, t) for t, n in total.items())[:k]
    got = features.word_vocabulary(df, "d", k, bigrams).collect()
    assert [(r["term"], r["total"], r["df"]) for r in got] == [(t, -n, held[t]) for n, t in want]
    assert features.word_vocabulary(df.filter("d < 0"), "d", k).collect() == []


def test_rare_pairs_are_never_grouped(spark, monkeypatch):
    """Rows grouped for the vocabulary: words, and pairs of frequent words; not every pair of the corpus."""
    rows = [(i, ["aa", "bb", f"r{i}", "aa", f"s{i}"]) for i in range(300)]
    df = spark.createDataFrame(rows, "d long, _words array<string>").repartition(4)
    monkeypatch.setattr(features, "term_statistics", None)  # what grouped all terms
    got = features.word_vocabulary(df, "d", 3).collect()
    assert [(r["term"], r["total"], r["df"]) for r in got] == [("aa", 600, 300), ("aa bb", 300, 300), ("bb", 300, 300)]


def test_sublinear_counts_stay_sparse(spark):
    from pyspark.ml.linalg import SparseVector, Vectors

    given = [Vectors.sparse(9, [1, 4], [1.0, 3.0]), Vectors.sparse(9, [], []), None, Vectors.dense([0.0, 2.0]), Vectors.sparse(9, [8], [2.0])]
    df = spark.createDataFrame(list(enumerate(given)), ["i", "tf"]).coalesce(1)
    got = [r["sub"] for r in models.SublinearTf("tf", "sub").transform(df).orderBy("i").collect()]
    assert got[2] is None and all(isinstance(got[i], SparseVector) for i in (0, 1, 4))
    for a, b in zip(given, got):
        if a is not None:
            assert b.toArray().tolist() == pytest.approx([1 + math.log(x) if x else 0.0 for x in a.toArray()])


def test_fits_use_few_partitions(spark):
    """As many as the rows need, not as many as the session shuffles with."""
    from failscope.operators import training

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    try:
        kept = [training.in_key_order(spark.range(n).withColumnRenamed("id", "k"), "k") for n in (0, 10, 9000)]
        assert [df.rdd.getNumPartitions() for df in kept] == [1, 1, 3]
        assert kept[2].distinct().count() == 9000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_neighbours_far_from_the_origin_are_exact(spark):
    """Products of matrices alone would lose distances this small beside vectors this long."""
    rng = np.random.default_rng(3)
    points = 1e6 + rng.normal(size=(300, 6)) * 1e-3
    df = spark.createDataFrame([(i, 1, p.tolist()) for i, p in enumerate(points)], "k long, g long, v array<double>")
    got = {}
    for r in oversample.knn_within_class(df, "g", "k", "v", 4, cell_rows=40).collect():
        got.setdefault(r["k"], []).append((r["rank"], r["neighbor"], r["distance"]))
    for i in range(300):
        d = sorted((float(np.sqrt(((points[i] - points[j]) ** 2).sum())), j) for j in range(300) if j != i)[:4]
        assert [(n, x) for _, n, x in sorted(got[i])] == [(j, x) for x, j in d]


def test_pairs_are_not_measured_one_by_one():
    """Distances to the pivots take no array of rows x pivots x dimensions."""
    import tracemalloc

    rng = np.random.default_rng(5)
    cells = oversample.Cells({"a": rng.normal(size=(1000, 64))})
    v = rng.normal(size=(500, 64))
    tracemalloc.start()
    got = cells.distances("a", v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28_000_000 and got[7] == pytest.approx(np.sqrt(((cells.pivots["a"] - v[7]) ** 2).sum(axis=1)))
