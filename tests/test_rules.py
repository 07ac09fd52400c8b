"""Golden rows for repair, flakiness and alerts, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from failscope.functions import repair, vocab
from failscope.functions.columns import percent_text, title_case
from failscope.operators import alerts, flaky
from failscope.operators.heal import heal
from failscope.operators.triage import triage

FLAKY = [
    (0.0, "Test Failure", "test", "MEDIUM", 30.0, 0.40, "Medium", True, "40%"),
    (2.0, "Test Failure", "test", "HIGH", 45.3, 0.75, "High", True, "75%"),
    (5.0, "Timeout", "test", "LOW", 121.0, 0.95, "High", True, "95%"),
    (1.0, "Build Error", "build", "CRITICAL", 60.0, 0.20, "Low", False, "20%"),
    (0.0, "Network Error", "deploy", "blocker", 61.0, 0.30, "Low", False, "30%"),
    (0.45, "Timeout", "build", "CRITICAL", 30.0, 0.29, "Low", False, "28%"),
    (None, "Timeout", "test", "LOW", 10.0, 0.00, "Unknown", False, "0%"),
]


def test_flaky_rows(spark):
    rows = [(i, *r) for i, r in enumerate(FLAKY)]
    df = spark.createDataFrame(
        rows,
        "i int, retry_count double, failure_type string, failure_stage string, severity string, "
        "test_duration_sec double, score double, risk string, flag boolean, text string",
    )
    for r in flaky.check_flaky(df).collect():
        a = r["flaky_analysis"]
        assert (a["flaky_probability"], a["risk_level"], a["is_flaky"], a["instability_score"]) == (
            r["score"], r["risk"], r["flag"], r["text"],
        )


LOCATORS = [
    ("#password-field", "anything", "#password-field", "[data-testid='password-field']"),
    ("", "org.openqa.selenium.NoSuchElementException: {#login-btn}", "#login-btn", "[data-testid='login-btn']"),
    ("N/A", "org.openqa.selenium.StaleElementReferenceException: stale", ".openqa", "[data-testid='openqa']"),
    ("", "element not interactable using locator //button[@id='pay']", "//button[@id='pay']", "[data-testid='button--id--pay']"),
    ("", "lookup failed By.id(x)", ".id", "[data-testid='id']"),
    ("", "no locator here", "#unknown-locator", "[data-testid='unknown-locator']"),
    ("", "second line\nxpath=//a\r\nmore", "xpath=//a\r", "[data-testid='xpath---a']"),
    ("", "bad #é-a here", "#é-a", "[data-testid='a']"),
]
WAITS = [
    ("", "flaky Time.Sleep(2) call", "time.sleep(", "time.sleep("),
    ("", "driver.implicitly_wait(3) expired", "implicitly_wait", "implicitly_wait"),
    ("", "fluent wait(5) expired", "wait(", "wait("),
    ("", "thread.sleep interrupted", "Thread.sleep", "Thread.sleep"),
    ("time.sleep(2)", "anything", "time.sleep(2)", None),
    ("", "element not clickable", "time.sleep(2)", None),
]
OTHERS = [
    ("TEST_DATA_ISSUE", "", "hardcoded / stale test data", "Pending", True),
    ("test_data_issue", "N/A", "N/A", "Pending", True),
    ("environment_failure", "", "environment service down", "Pending", True),
    ("network_api_error", "", "direct API call without retry", "Pending", True),
    ("application_defect", "", "N/A", "Rejected", True),
    ("something_new", "", "N/A", "Rejected", True),
]


def _heal(spark, rows):
    df = spark.createDataFrame(
        [(f"T{i}", *r) for i, r in enumerate(rows)],
        "test_id string, root_cause string, old_locator string, error_message string",
    )
    return [r["healing"] for r in heal(df).orderBy(F.expr("cast(substr(test_id, 2) as int)")).collect()]


def test_locator_rows(spark):
    got = _heal(spark, [("locator_issue", old, msg) for old, msg, _, _ in LOCATORS])
    assert [(h["old_value"], h["new_value"]) for h in got] == [r[2:] for r in LOCATORS]
    assert {h["status"] for h in got} == {"Suggested"} and not any(h["developer_alert"] for h in got)


def test_wait_rows(spark):
    got = _heal(spark, [("Synchronization_Issue", old, msg) for old, msg, _, _ in WAITS])
    want = [(old, vocab.WAIT_UPGRADES.get(key, vocab.WAIT_DEFAULT_UPGRADE)) for _, _, old, key in WAITS]
    assert [(h["old_value"], h["new_value"]) for h in got] == want


def test_other_causes(spark):
    got = _heal(spark, [(rc, old, "m") for rc, old, *_ in OTHERS])
    assert [(h["old_value"], h["status"], h["developer_alert"]) for h in got] == [r[2:] for r in OTHERS]


def test_error_rows_keep_the_job_alive(spark):
    got = _heal(spark, [(None, "", "m"), ("locator_issue", None, None), ("locator_issue", "#a", None), ("application_defect", None, None)])
    assert [h["healing_id"] == "H-ERROR" for h in got] == [True, True, False, False]
    assert got[0]["repair_type"] == "N/A" and got[0]["status"] == "Pending" and not got[0]["developer_alert"]


ROUTES = [
    ("developer", "environment_failure", "developer"),
    ("", "environment_failure", "devops"),
    ("ops", "NETWORK_API_ERROR", "devops"),
    ("", "something_new", "developer"),
    ("manager", "anything", "manager"),
]


def test_routes(spark):
    df = spark.createDataFrame(ROUTES, "req string, root_cause string, want string")
    for r in df.withColumn("got", alerts.route_target("root_cause", F.col("req"))).collect():
        assert r["got"] == r["want"]


@pytest.mark.parametrize("share,text", [(0.8721, "87%"), (0.125, "12%"), (0.145, "14%"), (1.0, "100%")])
def test_percent(spark, share, text):
    assert spark.range(1).select(percent_text(F.lit(share))).first()[0] == text


def test_title(spark):
    assert spark.range(1).select(title_case(F.lit("network_api_error"))).first()[0] == "Network Api Error"


def test_triage_defaults_and_alert(spark):
    df = spark.createDataFrame(
        [("T1", "Login", "CI", "boom", "environment_failure", 0.8721), ("T2", "Pay", "CI", "#x", "locator_issue", 0.5)],
        "test_id string, test_name string, pipeline string, error_message string, root_cause string, confidence double",
    )
    a, b = triage(df).orderBy("test_id").collect()
    assert a["flaky_analysis"]["flaky_probability"] == 0.40 and a["flaky_analysis"]["is_flaky"]
    assert a["notification"]["message"].startswith(
        "Test 'Login' failed with root cause 'environment_failure' (confidence: 87%). Retry after"
    )
    assert a["notification"]["target"] == "developer" and b["notification"] is None
    auto = triage(df, target="auto").orderBy("test_id").first()
    assert auto["notification"]["target"] == "devops"


def test_recent_pattern_and_flips_against_brute_force(spark):
    import random

    rng = random.Random(5)
    # One test holds most rows.
    rows = [(i, "hot" if rng.random() < 0.7 else f"t{rng.randrange(4)}", rng.choice(["PASS", "FAIL"]), 1_700_000_000 + rng.randrange(90_000)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, test_name string, outcome string, s long").withColumn(
        "created_at", F.timestamp_seconds("s")
    )
    by_test = {}
    for i, t, o, s in rows:
        by_test.setdefault(t, []).append((s, i, o))
    want_last, want_flips = {}, {}
    for t, rs in by_test.items():
        os_ = [o for _, _, o in sorted(rs)]
        want_last[t] = ", ".join(os_[-5:])
        want_flips[t] = (len(os_), sum(a != b for a, b in zip(os_, os_[1:])))
    assert {r["test_name"]: r["recent_pattern"] for r in flaky.recent_pattern(df).collect()} == want_last
    for width in (60, 3600, 30 * 86400):
        got = {r["test_name"]: (r["runs"], r["flips"]) for r in flaky.flip_rate(df, slice_seconds=width).collect()}
        assert got == want_flips
