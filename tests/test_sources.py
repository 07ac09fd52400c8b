"""Readers, writers and the batch store."""

import json
import os

import pytest
from pyspark.sql import functions as F

from failscope.operators import reports
from failscope.functions.vocab import TRAINING_FIELDS
from failscope.operators.clean import bool_coerce, numeric_coerce, split_rejected
from failscope.operators.triage import triage
from failscope.sources import readers, schemas, store


def test_csv_cells_with_breaks_quotes_and_bad_bytes(spark, tmp_path):
    head = ",".join(schemas.RUN_FIELDS)
    cells = [b"r1", b"repo", b"Jenkins"] + [b""] * (len(schemas.RUN_FIELDS) - 3)
    cells[schemas.RUN_FIELDS.index("error_message")] = b'"said ""no""\nand \xff left, then"'
    (tmp_path / "runs.csv").write_bytes(head.encode() + b"\n" + b",".join(cells) + b"\n")
    row = readers.scan_csv_runs(spark, str(tmp_path / "runs.csv")).first()
    assert row["error_message"] == 'said "no"\nand � left, then'
    assert row["run_id"] == "r1" and row["os"] is None


def test_training_csv_round_trip(spark, tmp_path):
    values = {f: f"  {f}, \"x\"\nline " for f in TRAINING_FIELDS}
    values.update(browser="N/A", os="nan")
    df = spark.createDataFrame([tuple(values[f] for f in TRAINING_FIELDS)], schemas.TRAINING_CSV)
    path = str(tmp_path / "t")
    readers.sink_csv_training(df, path)
    assert readers.scan_csv_training(spark, path, missing=False).first().asDict() == values
    row = readers.scan_csv_training(spark, path).first()
    assert row["browser"] is None and row["os"] is None and row["branch"] == values["branch"]


UPLOADS = {
    "a.json": json.dumps({"testName": "T", "test_name": "", "message": "boom", "retry_count": None, "old_value": "#x"}),
    "b.json": json.dumps({"error_message": "e", "retry_count": "abc"}),
    "c.log": "first\n  at X.run(X.java)\nmy Exception\nlast",
    "d.txt": "\nsecond line",
    "e.log": "nothing of note\nlook at this",
    "f.json": "{broken",
    "g.json": "null",
    "h.log": "x" * 700,
}


def test_uploads(spark, tmp_path):
    for name, text in UPLOADS.items():
        (tmp_path / name).write_text(text)
    got = {r["file_name"]: r for r in readers.route_by_format(readers.read_uploads(spark, str(tmp_path))).collect()}
    a, b, c, d, e, f, g, h = (got[n] for n in UPLOADS)
    assert (a["format"], a["test_name"], a["error_message"], a["retry_count"], a["old_locator"]) == ("json", "T", "boom", 0.0, "#x")
    assert a["pipeline"] == "GitHub Actions" and a["severity"] == "MEDIUM"
    assert (b["test_name"], b["retry_count"]) == ("b.json", None)
    assert (c["format"], c["test_name"], c["error_message"]) == ("text", "c", "first")
    assert c["stack_trace"] == "  at X.run(X.java)\nmy Exception" and c["logs"] == UPLOADS["c.log"]
    assert d["error_message"] == "\nsecond line"
    assert e["stack_trace"] == ""
    assert f["format"] == "text" and f["test_name"] == "f" and g["format"] == "text"
    assert h["error_message"] == "x" * 500 and h["logs"] == "x" * 700


def test_coercion(spark):
    df = spark.createDataFrame(
        [("abc", None, "1e1", "1d", "True"), (" 4 ", "7", "x", "2.5", "1")],
        "retry_count string, test_duration_sec string, cpu_usage_pct string, memory_usage_mb string, is_flaky_test string",
    )
    assert [tuple(r) for r in bool_coerce(numeric_coerce(df)).collect()] == [
        (0.0, 30.0, 10.0, 1024.0, 1), (4.0, 7.0, 50.0, 2.5, 0),
    ]
    assert bool_coerce(df, digits=True).collect()[1]["is_flaky_test"] == 1
    flags = spark.createDataFrame([(True,), (False,), (None,)], "is_flaky_test boolean")
    assert [r[0] for r in bool_coerce(flags).collect()] == [1, 0, 0]


def test_rejects(spark):
    df = spark.createDataFrame([("a", "b"), ("", "b"), ("a", None)], "test_name string, error_message string")
    good, bad = split_rejected(df)
    assert good.count() == 1
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["error_message is required", "test_name is required"]


@pytest.fixture
def batch(spark):
    df = spark.range(40).select(
        "id",
        F.concat(F.lit("T"), "id").alias("test_id"),
        F.lit("n").alias("test_name"),
        F.lit("CI").alias("pipeline"),
        F.lit("boom").alias("error_message"),
        F.expr("element_at(array('locator_issue', 'environment_failure'), cast(id % 2 as int) + 1)").alias("root_cause"),
        F.lit(0.5).alias("confidence"),
        F.expr("case when id % 4 = 0 then 'build' end").alias("failure_stage"),
    )
    return triage(df)


def test_store_commits_by_manifest_and_replays(spark, batch, tmp_path):
    root = str(tmp_path / "store")
    store.persist_fanout(batch, root, "b1")
    store.persist_fanout(batch, root, "b1", cache=True)

    def counts():
        return reports.summary_counts({n: store.scan_table(spark, root, n) for n in schemas.TABLES}).first()

    first = tuple(counts())
    assert first == (40, 40, 30, 20)
    # A batch without its manifest row is not seen.
    half = store.table_rows(batch)["failures"].withColumn(store.DAY, F.to_date("created_at"))
    half.write.partitionBy(store.DAY).parquet(f"{root}/failures/batch=b2")
    assert tuple(counts()) == first


def test_scratch_dir_follows_the_session(spark):
    named = {"spark.checkpoint.dir": "file:///shared/", "spark.sql.warehouse.dir": "/wh"}
    assert store.shared_root(lambda k, d: named.get(k, d)) == "file:///shared"
    del named["spark.checkpoint.dir"]
    assert store.shared_root(lambda k, d: named.get(k, d)) == "/wh/_scratch"
    with pytest.raises(ValueError):
        store.shared_root(lambda k, d: d)
    assert store.scratch_dir(spark, "x").startswith(store.shared_root(spark.conf.get))


def test_added_column(spark):
    df = spark.createDataFrame([(1,)], "id int")
    assert str(store.add_created_at(df, "2024-01-01 00:00:00").first()["created_at"]).startswith("2024-01-01")
