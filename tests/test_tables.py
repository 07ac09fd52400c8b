"""Table changes and reports on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from failscope.operators import evaluate, reports, tables


@pytest.fixture
def failures(spark):
    rows = [
        (1, "A", "n1", "CI", "FAIL", "locator_issue", "50%", "Suggested"),
        (2, "B", "n2", "CI", "FAIL", "environment_failure", "50%", "Pending"),
        (3, "C", "n3", "CI", "FAIL", "something_new", "50%", "Rejected"),
    ]
    cols = "id long, test_id string, test_name string, pipeline string, status string, root_cause string, confidence string, healing string"
    return spark.createDataFrame(rows, cols)


@pytest.fixture
def healing(spark):
    rows = [(10, "H1", "A", "Suggested"), (11, "H2", "A", "Suggested"), (12, "H3", "B", "Pending")]
    return spark.createDataFrame(rows, "id long, healing_id string, failure_test_id string, status string")


def keys(spark, *ks):
    return spark.createDataFrame([(k,) for k in ks], "test_id string")


def test_apply_heal(spark, failures, healing):
    f, h = tables.apply_heal(failures, healing, keys(spark, "A", "B", "A", "Z"))
    assert {r["test_id"]: (r["status"], r["healing"]) for r in f.collect()} == {
        "A": ("HEALED", "Applied"), "B": ("HEALED", "Applied"), "C": ("FAIL", "Rejected"),
    }
    assert {r["id"]: r["status"] for r in h.collect()} == {10: "Applied", 11: "Suggested", 12: "Applied"}
    f, _ = tables.apply_heal(failures, healing, keys(spark, "A", "B"), only_suggested=True)
    assert {r["test_id"] for r in f.filter("status = 'HEALED'").collect()} == {"A"}
    assert [r[0] for r in tables.missing_keys(keys(spark, "A", "Z"), failures).collect()] == ["Z"]


def test_delete_cascade(spark, failures, healing):
    flaky = spark.createDataFrame([(1, "A"), (2, "Z")], "id long, test_code string")
    notes = spark.createDataFrame([(1, "A"), (2, "B")], "id long, failure_test_id string")
    left = tables.delete_cascade(
        {"failures": failures, "healing_actions": healing, "flaky_tests": flaky, "notifications": notes},
        keys(spark, "A", "Z"),
    )
    assert {n: sorted(r["id"] for r in df.collect()) for n, df in left.items()} == {
        "failures": [2, 3], "healing_actions": [12], "flaky_tests": [2], "notifications": [2],
    }


def test_append_rejects_bad_old_and_repeated_rows(spark, failures):
    new = failures.limit(0).unionByName(
        spark.createDataFrame(
            [(7, "D", "n", "CI", "FAIL", "x", None, None), (6, "D", "n", "CI", "FAIL", "x", None, None),
             (8, "A", "n", "CI", "FAIL", "x", None, None), (9, "E", None, "CI", "FAIL", "x", None, None)],
            failures.schema,
        )
    )
    assert [(r["id"], r["test_id"]) for r in tables.append_rows(failures, new).collect()] == [(6, "D")]


def test_group_limits_and_pushdown_are_planned(spark, data_dir):
    from failscope.plans.queries import QUERIES

    def plan(key):
        return QUERIES[key](spark, data_dir)._jdf.queryExecution().executedPlan().toString()

    assert "WindowGroupLimit" in plan("recent_pattern")
    assert "WindowGroupLimit" in plan("append_rows")
    assert "GreaterThanOrEqual(ts,2024-01-23T23:59:59)" in plan("failure_trend").split("PushedFilters:", 1)[1]
    for key in ("triage", "heal", "check_flaky", "threshold_split"):
        assert "Exchange" not in plan(key) and "Python" not in plan(key)
    assert "CartesianProduct" not in plan("summary_counts")
    assert "TakeOrderedAndProject" in plan("page_failures")


def test_trend(spark):
    df = spark.createDataFrame(
        [("2024-01-30 10:00:00",), ("2024-01-24 00:00:00",), ("2024-01-23 23:59:59",), (None,)], "t string"
    ).select(F.col("t").cast("timestamp").alias("created_at"))
    got = reports.failure_trend(df, "2024-01-30 23:59:59").orderBy("position").collect()
    assert [r["name"] for r in got] == ["Wed 24", "Thu 25", "Fri 26", "Sat 27", "Sun 28", "Mon 29", "Tue 30"]
    assert [r["failures"] for r in got] == [1, 0, 0, 0, 0, 0, 1]
    three = df.limit(3)
    got = reports.failure_trend(three, "2030-01-01 00:00:00", fallback=True).orderBy("position").collect()
    assert [r["failures"] for r in got] == [3, 2, 1, 0, 0, 0, 0]


def test_breakdown_pages_and_scores(spark, failures):
    got = {r["name"]: (r["value"], r["color"]) for r in reports.root_cause_breakdown(failures).collect()}
    assert got["Locator Issue"] == (1, "#60a5fa") and got["Something New"] == (1, "#6b7280")
    page = reports.page(failures, [F.desc("id")], 2, 2).collect()
    assert [(r["id"], r["total"], r["page"]) for r in page] == [(1, 3, 2)]
    assert [r["id"] for r in reports.page_after(failures, 3, 10).collect()] == [2, 1]
    assert reports.total_pages(failures, 2).first()["total_pages"] == 2
    flaky = spark.createDataFrame([("40%", "medium"), ("45%", "HIGH"), ("n/a", "Low")], "instability_score string, risk_level string")
    assert reports.avg_instability(flaky).first()[0] == 43
    assert reports.avg_instability(flaky.limit(0)).first()[0] == 0
    assert [tuple(r) for r in reports.risk_share(flaky).collect()] == [("High", 1, 33), ("Medium", 1, 33), ("Low", 1, 33)]
    assert [r["percent"] for r in reports.risk_share(flaky.limit(0)).collect()] == [0, 0, 0]


def test_metrics_by_hand(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    got = {(r["class"], r["metric"]): r["value"] for r in evaluate.metrics_table(df, "m").collect()}
    assert got[("a", "precision")] == 0.75 and got[("a", "recall")] == 0.75 and got[("b", "precision")] == 0.6667
    assert got[("c", "f1")] == 0.0 and got[("c", "support")] == 1.0
    assert got[(None, "accuracy")] == 0.7143
    tie = spark.createDataFrame([("RandomForest", 0.5), ("GradientBoosting", 0.5)], "model string, accuracy double")
    assert evaluate.select_best(tie).first()["model_name"] == "RandomForest"
    assert evaluate.select_best(tie, "GradientBoosting").first()["model_name"] == "GradientBoosting"
