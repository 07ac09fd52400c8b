"""A stream over files gives what the batch gives; a replay changes nothing."""

import pytest
from pyspark.sql import functions as F

from failscope.operators import flaky, reports
from failscope.operators.triage import triage
from failscope.plans.views import view
from failscope.sources import schemas, store
from failscope.streaming import jobs


@pytest.fixture
def source(spark, data_dir, tmp_path):
    rows = view(spark, data_dir, "failures_src").withColumn("created_at", F.col("created_at").cast("timestamp"))
    path = str(tmp_path / "in")
    rows.repartitionByRange(3, "created_at").write.json(path)
    return rows, path


def test_triage_over_several_batches(spark, source, tmp_path):
    rows, path = source
    root, mark = str(tmp_path / "store"), str(tmp_path / "mark")
    for _ in range(2):  # the second start finds nothing new
        stream = jobs.failure_stream(spark, path, rows.schema, files_per_batch=1)
        jobs.stream_triage(stream, root, mark).awaitTermination()
    got = reports.summary_counts({n: store.scan_table(spark, root, n) for n in schemas.TABLES}).first()
    want = reports.summary_counts(store.table_rows(triage(rows))).first()
    assert tuple(got) == tuple(want)


def test_recent_pattern_over_several_batches(spark, source, tmp_path):
    rows, path = source
    out = str(tmp_path / "out")
    stream = jobs.failure_stream(spark, path, rows.schema, files_per_batch=1)
    jobs.stream_recent_pattern(stream, out, str(tmp_path / "mark")).awaitTermination()
    got = {tuple(r) for r in jobs.read_recent_pattern(spark, out).collect()}
    assert got == {tuple(r) for r in flaky.recent_pattern(rows).select("test_name", "recent_pattern").collect()}


def pattern_rows(spark, path, rows):
    """JSON files of (test_name, minute, id, outcome), one more file per call."""
    made = spark.createDataFrame(rows, "test_name string, minute long, id long, outcome string")
    made = made.withColumn("created_at", F.timestamp_seconds(1_700_000_000 + F.col("minute") * 60)).drop("minute")
    made.coalesce(1).write.mode("append").json(path)
    return made.schema


def test_recent_pattern_restarts_from_its_checkpoint(spark, tmp_path):
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    hot = [("hot", m, m, "pass" if m % 3 else "fail") for m in range(2000)] + [(None, 5, 1, "pass"), ("odd", 7, None, "fail")]
    schema = pattern_rows(spark, path, hot)
    for more in ([], [("hot", 3000, 9, "fail"), ("hot", 1, 10, "late"), ("hot", 1999, 1999, "pass"), ("new", 3000, 9, "pass")]):
        if more:
            pattern_rows(spark, path, more)
        jobs.stream_recent_pattern(jobs.failure_stream(spark, path, schema), out, mark).awaitTermination()
    got = dict(tuple(r) for r in jobs.read_recent_pattern(spark, out).collect())
    last = ", ".join("pass" if m % 3 else "fail" for m in range(1996, 2000)) + ", fail"
    assert got == {"hot": last, None: "pass", "new": "pass"}
    jobs.compact_recent_pattern(spark, out, str(tmp_path / "small"))
    assert dict(tuple(r) for r in jobs.read_recent_pattern(spark, str(tmp_path / "small")).collect()) == got


def test_recent_pattern_forgets_idle_tests(spark, tmp_path):
    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    hour = 60
    # "a" runs once, "b" again and again; the third start finds the state of "a" gone, that of "b" not.
    for at, rows in enumerate([
        [("a", 0, 1, "old"), ("b", 0, 2, "b0")], [("b", 5 * hour, 3, "b1")], [("b", 9 * hour, 4, "b2")],
        [("a", 10 * hour, 5, "new"), ("b", 10 * hour, 6, "b3")],
    ]):
        schema = pattern_rows(spark, path, rows)
        stream = jobs.failure_stream(spark, path, schema, files_per_batch=1)
        jobs.stream_recent_pattern(stream, out, mark, idle_ms=6 * 3600 * 1000, delay="1 hour").awaitTermination()
    got = dict(tuple(r) for r in jobs.read_recent_pattern(spark, out).collect())
    assert got == {"a": "new", "b": "b0, b1, b2, b3"}


def test_dedupe(spark, source, tmp_path):
    rows, path = source
    rows.write.mode("append").json(path)
    out = str(tmp_path / "out")
    jobs.stream_dedupe(
        jobs.failure_stream(spark, path, rows.schema), out, str(tmp_path / "mark"), delay="60 days"
    ).awaitTermination()
    assert spark.read.parquet(out).count() == rows.count()


def test_trend_drops_open_days(spark, source, tmp_path):
    rows, path = source
    out = str(tmp_path / "out")
    jobs.stream_trend(jobs.failure_stream(spark, path, rows.schema), out, str(tmp_path / "mark")).awaitTermination()
    got = {(r["day"], r["failures"]) for r in spark.read.parquet(out).collect()}
    last = rows.agg(F.max("created_at")).first()[0]
    want = {(r["day"], r["count"]) for r in rows.groupBy(F.date_trunc("day", "created_at").alias("day")).count().collect()}
    assert got <= want and len(want - got) <= 2 and max(d for d, _ in got) < last
