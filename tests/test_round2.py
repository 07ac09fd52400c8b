"""Gaps in input, whole tables behind bounded fits, and the store's snapshots."""

import pytest
from pyspark.sql import functions as F

from failscope.functions import vocab
from failscope.functions.columns import title_case
from failscope.operators import features, flaky, models, oversample, sampling, tables
from failscope.operators.training import TrainingSet, report
from failscope.operators.triage import analyze, triage
from failscope.plans.views import view
from failscope.sources import readers, schemas, store


@pytest.fixture(scope="module")
def failures(spark, data_dir):
    rows = view(spark, data_dir, "failures_src").cache()
    yield rows
    rows.unpersist()


@pytest.fixture(scope="module")
def prepared(failures):
    data = TrainingSet(failures, cap=10)
    yield data
    data.release()


@pytest.fixture(scope="module")
def forest(prepared):
    return models.train_random_forest(prepared.train, trees=5, depth=5)


def test_cap_bounds_the_fit_only(failures, prepared):
    n, known = failures.count(), failures.filter(F.col("root_cause").isin(vocab.ROOT_CAUSES))
    tested = known.groupBy("root_cause").count().select(F.sum(F.floor(F.col("count") * 0.2 + 0.5))).first()[0]
    assert prepared.train.count() <= 10 * len(vocab.ROOT_CAUSES)
    assert prepared.test_rows.count() == tested and prepared.features().count() == n


def test_gaps_are_scored(failures, prepared, forest):
    names = ["error_message", "stack_trace", "failure_type", "severity", "retry_count", "cpu_usage_pct", "is_flaky_test"]
    gaps = failures.limit(40).withColumns({c: F.lit(None).cast(dict(failures.dtypes)[c]) for c in names})
    rows = models.score_failures(gaps, prepared.stages, forest).collect()
    assert len(rows) == 40 and all(r["root_cause"] in vocab.ROOT_CAUSES for r in rows)
    filled = failures.limit(40).withColumns({c: F.lit(vocab.INPUT_DEFAULTS.get(c, "")).cast(dict(failures.dtypes)[c]) for c in names})
    again = {r["test_id"]: r["confidence"] for r in models.score_failures(filled, prepared.stages, forest).collect()}
    assert again == {r["test_id"]: r["confidence"] for r in rows}


def test_baselines_and_grid(spark, data_dir, prepared):
    runs = view(spark, data_dir, "runs_src").filter("failure_type is not null").limit(300).cache()
    text = models.train_text_baseline(runs, "run_id", iterations=5, k=50)
    assert text.transform(runs).filter("prediction is not null").count() == 300
    bad = runs.withColumn("cpu_usage_pct", F.lit("n/a"))
    plain = models.train_structured_baseline(bad, trees=2, depth=3)
    assert plain.transform(bad).count() == 300
    grid = models.tune_grid(prepared.train, trees=(2,), depths=(2, 3), folds=2)
    assert len(grid.avgMetrics) == 2 and all(0 <= x <= 1 for x in grid.avgMetrics)
    boosted = models.train_gradient_boosting(prepared.train, rounds=1)
    assert report(boosted, prepared.test(), "b").filter("metric = 'accuracy'").first()["value"] <= 1
    runs.unpersist()


def test_indexed_columns_must_be_categories(spark):
    wide = spark.range(2000).select(F.col("id").cast("string").alias("failure_type"))
    with pytest.raises(ValueError, match="no category"):
        models.few_labels(wide, ["failure_type"])


def test_uploads_end_to_end(spark, prepared, forest):
    files = [("a.json", '{"test_name": 0, "testName": "T", "error_message": "boom", "retry_count": 2}'), ("b.log", "first line\nError: x"),
             ("c.json", '{"test_name": false, "message": 0}'), ("b.log", "first line\nError: x")]
    done, bad = analyze(spark.createDataFrame(files, "file_name string, text string"), prepared.stages, forest)
    rows = done.collect()
    assert sorted(r["test_name"] for r in rows) == ["T", "b", "b"] and len({r["test_id"] for r in rows}) == 2
    assert all(r["test_id"].startswith("TEST-") and r["healing"]["healing_id"] for r in rows)
    assert [(r["test_name"], r["reject_reason"]) for r in bad.collect()] == [("c.json", "error_message is required")]


def test_zero_and_false_are_empty(spark):
    texts = ['{"test_name": 0}', '{"test_name": false}', '{"test_name": 0.0}', '{"test_name": "0"}', '{"test_name": "false"}', '{"test_name": 7}', '{"test_name": true}']
    df = spark.createDataFrame([(t, "file") for t in texts], "text string, file_name string")
    assert [r[0] for r in readers.ingest_json(df).select("test_name").collect()] == ["file", "file", "file", "0", "false", "7", "true"]


def test_title_case(spark):
    texts = ["db-timeout_x", "network_api_error", "it's 3rd", "ALL_caps", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(title_case("t")).collect()] == [t.replace("_", " ").title() for t in texts]


def test_append_needs_all_required_columns(spark):
    empty = spark.createDataFrame([], schemas.FAILURES)
    with pytest.raises(ValueError, match="pipeline"):
        tables.append_rows(empty, empty.drop("pipeline"), "failures")


def test_no_row_is_lost(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("other", 3), (None, 4)], "label string, k int")
    assert sampling.stratified_split(df, "label", "k", classes=["a"]).count() == 4
    rows = spark.createDataFrame([("t", None, 1, "P"), ("t", "2024-01-01", 2, "F"), ("t", "2024-01-02", 3, "F")], "test_name string, created_at string, id int, outcome string")
    got = flaky.flip_rate(rows.withColumn("created_at", F.col("created_at").cast("timestamp"))).first()
    assert (got["runs"], got["flips"]) == (3, 1)


def test_codes_of_many_values(spark):
    values = spark.range(5000).select(F.format_string("v%05d", F.col("id")).alias("c")).repartition(5)
    got = features.category_codes(values, "c").orderBy("category").collect()
    assert [r["code"] for r in got] == list(range(5000))


def test_only_asking_rows_get_neighbours(spark):
    df = spark.range(50).select(F.lit("x").alias("l"), "id", F.array(F.col("id").cast("double")).alias("v"), (F.col("id") < 5).alias("q"))
    got = oversample.knn_within_class(df, "l", "id", "v", k=1, block_rows=10, asks="q").collect()
    assert {(r["id"], r["neighbor"]) for r in got} == {(0, 1), (1, 0), (2, 1), (3, 2), (4, 3)}


def test_snapshots(spark, failures, tmp_path):
    root = str(tmp_path / "store")
    analyzed = triage(failures.limit(60))
    assert store.current_epoch(spark, root) == 0
    store.persist_fanout(analyzed.filter("id % 2 = 0"), root, "b1")
    store.persist_fanout(analyzed.filter("id % 2 = 1"), root, "b2")
    before = store.scan_table(spark, root, "failures")
    n = before.count()
    assert store.write_snapshot({"failures": before.filter("id % 3 <> 0")}, spark, root) == 1
    left = store.scan_table(spark, root, "failures")
    assert 0 < left.count() < n and left.columns == schemas.FAILURES.names
    assert store.scan_table(spark, root, "healing_actions").count() == n
    store.persist_fanout(triage(failures.filter("id = 900")), root, "b3")
    assert store.scan_table(spark, root, "failures").count() == left.filter("id <> 900").count() + 1
    plan = store.failures_of_days(spark, root, "2024-01-02", "2024-01-03")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_halves_are_written_without_a_kept_copy_of_the_analysis(spark, data_dir, monkeypatch):
    """The nested analysis of all rows is several times their size; each table computes what it needs."""
    from failscope.plans import queries

    monkeypatch.setattr(type(spark.range(1)), "persist", lambda *a, **k: pytest.fail("a copy is kept"))
    root = queries._saved_halves(spark, data_dir)
    assert store.scan_table(spark, root, "failures").count() == view(spark, data_dir, "failures_src").filter("created_at IS NOT NULL").count()
