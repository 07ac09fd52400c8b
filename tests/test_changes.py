"""Change records and counters of a store, against whole-table changes and full scans."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from failscope.operators import reports, tables
from failscope.operators.triage import triage
from failscope.sources import schemas, store

AS_OF = "2024-01-30 23:59:59"


@pytest.fixture
def batch(spark):
    df = spark.range(300).select(
        "id",
        F.concat(F.lit("T"), "id").alias("test_id"),
        F.lit("n").alias("test_name"),
        F.lit("CI").alias("pipeline"),
        F.lit("boom").alias("error_message"),
        F.expr("element_at(array('locator_issue', 'environment_failure', 'synchronization_issue'), cast(id % 3 as int) + 1)").alias("root_cause"),
        F.lit(0.5).alias("confidence"),
        F.expr("case when id % 4 = 0 then 'build' end").alias("failure_stage"),
        F.expr("timestamp'2024-01-20 10:00:00' + make_interval(0, 0, 0, cast(id % 12 as int))").alias("created_at"),
    )
    return triage(df)


def rows(tables_):
    return {n: sorted(df.select(*schemas.TABLES[n].names).collect(), key=lambda r: str(r["id"])) for n, df in tables_.items()}


def scan(spark, root):
    return {n: store.scan_table(spark, root, n) for n in schemas.TABLES}


def reports_of(spark, root):
    """Every report once from the tables and once from the counters."""
    now, counts = scan(spark, root), store.counters(spark, root)
    pairs = [
        (reports.summary_counts(now), reports.summary_from_counters(counts)),
        (reports.root_cause_breakdown(now["failures"]), reports.breakdown_from_counters(counts)),
        (reports.risk_distribution(now["flaky_tests"]), reports.risk_from_counters(counts)),
        (reports.failure_trend(now["failures"], AS_OF), reports.trend_from_counters(counts, AS_OF)),
        (reports.failure_trend(now["failures"], "2034-01-30 23:59:59", fallback=True),
         reports.trend_from_counters(counts, "2034-01-30 23:59:59", fallback=True)),
    ]
    for a, b in pairs:
        assert a.columns == b.columns
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def size(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True))


def test_changes_equal_rewritten_tables(spark, batch, tmp_path):
    root = str(tmp_path / "store")
    store.persist_fanout(batch.filter("id % 2 = 0"), root, "b1")
    store.persist_fanout(batch.filter("id % 2 = 1"), root, "b2")
    reports_of(spark, root)
    keys = spark.createDataFrame([("T3",), ("T3",), ("T8",), ("T11",), ("none",)], "test_id string")
    want = scan(spark, root)
    want = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in want.items()}

    failures, healing = tables.apply_heal(want["failures"], want["healing_actions"], keys)
    want |= {"failures": failures, "healing_actions": healing}
    assert tables.store_heal(spark, root, keys, "h1") and not tables.store_heal(spark, root, keys, "h1")
    assert rows(scan(spark, root)) == rows(want)
    assert size(f"{root}/changes/batch=h1") < size(f"{root}/failures") / 3
    assert store.scan_table(spark, root, "failures").filter("healing = 'Applied'").count() == 3

    gone = spark.createDataFrame([("T8",), ("T9",), ("none",)], "test_id string")
    want = tables.delete_cascade(want, gone)
    assert tables.store_delete(spark, root, gone, "d1") and not tables.store_delete(spark, root, gone, "d1")
    assert tables.store_delete(spark, root, gone, "d2")  # finds nothing any more
    assert rows(scan(spark, root)) == rows(want)
    reports_of(spark, root)

    ids = spark.createDataFrame([(12,), (13,)], "id long")
    want["notifications"] = tables.delete_one(want["notifications"], ids, "id")
    tables.store_delete_one(spark, root, "notifications", ids, "id", "d3")
    assert rows(scan(spark, root)) == rows(want)

    # A batch that is written again stays as it is: changed rows do not come back.
    store.persist_fanout(batch.filter("id % 2 = 0"), root, "b1")
    assert rows(scan(spark, root)) == rows(want)
    # Rows that a later batch brings are new ones; a deletion before it does not touch them.
    store.persist_fanout(batch.filter("id = 8"), root, "b3")
    assert store.scan_table(spark, root, "failures").filter("id = 8").select("status").collect() == [("FAIL",)]
    reports_of(spark, root)

    before = rows(scan(spark, root))
    assert store.compact(spark, root) == 1
    assert rows(scan(spark, root)) == before
    reports_of(spark, root)
    # Neither does a change or batch from before the compaction count twice.
    assert not tables.store_delete(spark, root, gone, "d1")
    store.persist_fanout(batch.filter("id % 2 = 1"), root, "b2")
    assert rows(scan(spark, root)) == before
    tables.store_heal(spark, root, spark.createDataFrame([("T8",)], "test_id string"), "h2")
    assert store.scan_table(spark, root, "failures").filter("id = 8").select("status").collect() == [("HEALED",)]
    days = store.failures_of_days(spark, root, "2024-01-20", "2024-01-31")
    assert days.count() == len(before["failures"])


def test_only_suggested_repairs(spark, batch, tmp_path):
    root = str(tmp_path / "store")
    store.persist_fanout(batch, root, "b1")
    keys = batch.select("test_id")
    now = scan(spark, root)
    failures, healing = tables.apply_heal(now["failures"], now["healing_actions"], keys, only_suggested=True)
    want = [rows({"failures": failures})["failures"], rows({"healing_actions": healing})["healing_actions"]]
    tables.store_heal(spark, root, keys, "h", only_suggested=True)
    got = rows(scan(spark, root))
    assert [got["failures"], got["healing_actions"]] == want


def test_a_change_without_its_manifest_row_is_not_seen(spark, batch, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    store.persist_fanout(batch, root, "b1")
    before = rows(scan(spark, root))
    keys = spark.createDataFrame([("T3",)], "test_id string")

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", dies)
        with pytest.raises(RuntimeError):
            tables.store_delete(spark, root, keys, "d1")
    assert rows(scan(spark, root)) == before
    reports_of(spark, root)
    assert tables.store_delete(spark, root, keys, "d1")
    assert len(rows(scan(spark, root))["failures"]) == len(before["failures"]) - 1
    reports_of(spark, root)


def test_counters_read_no_table(spark, batch, tmp_path):
    root = str(tmp_path / "store")
    store.persist_fanout(batch, root, "b1")
    files = store.counters(spark, root).inputFiles()
    assert files and not any(f"/{n}/" in f for f in files for n in schemas.TABLES)
