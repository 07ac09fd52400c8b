"""Key filters and ranges of a store, against scans of the whole store."""

import re
import shutil

import pytest
from pyspark.sql import functions as F

from failscope.operators import reports, tables
from failscope.operators.triage import triage
from failscope.sources import index, schemas, store


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """A store of three batches, with repairs and deletions."""
    df = spark.range(600).select(
        "id", F.concat(F.lit("T"), "id").alias("test_id"), F.lit("n").alias("test_name"), F.lit("CI").alias("pipeline"),
        F.lit("boom").alias("error_message"),
        F.expr("element_at(array('locator_issue', 'environment_failure', 'synchronization_issue'), cast(id % 3 as int) + 1)").alias("root_cause"),
        F.lit(0.5).alias("confidence"), F.expr("case when id % 4 = 0 then 'build' end").alias("failure_stage"),
        F.expr("timestamp'2024-01-20 10:00:00' + make_interval(0, 0, 0, cast(id % 12 as int), cast(id % 5 as int))").alias("created_at"),
    )
    root = str(tmp_path_factory.mktemp("index") / "store")
    for i in range(3):
        store.persist_fanout(triage(df.filter(F.expr(f"id div 200 = {i}"))), root, f"b{i}")
    keys = spark.createDataFrame([("T3",), ("T225",), ("T599",)], "test_id string")
    tables.store_heal(spark, root, keys, "heal")
    tables.store_delete(spark, root, keys.filter("test_id <> 'T3'"), "delete")
    return root


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("keys, batches", [
    (["T3", "T3", "T7", "T225", None, "none"], {"b0", "b1"}), (["T599"], {"b2"}), ([], set()), ([None], set()), (["none", "x"], set()),
])
def test_lookups_read_the_batches_of_their_keys(spark, saved, keys, batches):
    asked = spark.createDataFrame([(k,) for k in keys], "test_id string")
    whole = store.scan_table(spark, saved, "failures")
    got = tables.store_lookup(spark, saved, asked)
    assert sorted_rows(got) == sorted_rows(tables.lookup_failures(whole, asked).select(*got.columns))
    assert sorted_rows(tables.store_missing(spark, saved, asked)) == sorted_rows(tables.missing_keys(asked, whole))
    done = store.manifest(spark, saved).filter("kind = 'rows'")
    named = index.batches_with(spark, saved, "failures", asked, done)
    # False hits are allowed, but not many; a batch that holds a key is always named.
    assert batches <= set(named) and len(named) <= len(batches) + 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = " ".join(re.findall(r"PartitionFilters: \[([^\]]*)\]", plan))
    assert set(re.findall(r"\bb\d\b", filters)) == set(named)


def test_every_key_is_in_its_filter(spark, saved):
    for name in schemas.TABLES:
        key = schemas.FAILURE_KEYS[name]
        rows = spark.read.parquet(f"{saved}/{name}").select(F.col(key), "batch").distinct()
        found = index.hits(index.read_filters(spark, saved, name), rows, key)
        assert rows.join(found, [key, "batch"], "left_anti").count() == 0
        assert found.count() <= rows.count() * 1.1


def test_batches_without_filter_are_read(spark, saved, tmp_path):
    copy = str(tmp_path / "store")
    shutil.copytree(saved, copy)
    done = store.manifest(spark, copy).filter("kind = 'rows'")
    asked = spark.createDataFrame([("T3",)], "test_id string")
    shutil.rmtree(f"{copy}/keys/batch=b0")
    assert set(index.batches_with(spark, copy, "failures", asked, done)) >= {"b0"}
    assert store.scan_keys(spark, copy, "failures", asked).count() == 1
    shutil.rmtree(f"{copy}/keys")
    assert index.batches_with(spark, copy, "failures", asked, done) is None
    assert store.scan_keys(spark, copy, "failures", asked).count() == 1


def test_appended_rows_are_new(spark, saved):
    whole = store.scan_table(spark, saved, "failures")
    incoming = whole.limit(50).unionByName(whole.limit(30).withColumns({"id": F.col("id") + 1000, "test_id": F.concat("test_id", F.lit("x"))}))
    incoming = spark.createDataFrame(incoming.collect(), whole.schema)
    assert sorted_rows(tables.store_new_rows(spark, saved, incoming)) == sorted_rows(tables.append_rows(whole, incoming))
    assert tables.store_new_rows(spark, saved, incoming).count() == 30


@pytest.mark.parametrize("name", ["failures", "flaky_tests"])
def test_pages_equal_whole_sorts(spark, saved, name):
    rows = store.scan_table(spark, saved, name)
    order = ([F.desc("created_at")] if name == "failures" else []) + [F.desc("id")]
    for number, size in ((1, 10), (3, 7), (60, 10), (2, 400), (9999, 10)):
        got = store.page(spark, saved, name, number, size).collect()
        want = reports.page(rows, order, number, size).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want], (number, size)


def test_pages_with_missing_times_and_old_counters(spark, saved, tmp_path):
    rows = store.scan_table(spark, saved, "failures").withColumn("created_at", F.expr("case when id % 3 > 0 then created_at end"))
    rest = {n: store.scan_table(spark, saved, n) for n in schemas.TABLES if n != "failures"}
    root = str(tmp_path / "odd")
    store.write_batch({"failures": rows, **rest}, root, "one", 0, 1)
    for number in (1, 40, 41, 60):
        got = store.page(spark, root, "failures", number).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in reports.page(rows, [F.desc("created_at"), F.desc("id")], number).collect()]
    whole = spark.read.schema(store.COUNTS).parquet(f"{root}/counts/batch=one")
    old = spark.createDataFrame(whole.filter("dimension <> 'range'").collect(), whole.schema)
    old.write.mode("overwrite").parquet(f"{root}/counts/batch=one")
    got = store.page(spark, root, "failures", 40).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in reports.page(rows, [F.desc("created_at"), F.desc("id")], 40).collect()]


def test_deep_page_reads_few_folders(spark, saved):
    plan = store.page(spark, saved, "failures", 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(created_at" in plan


def test_ranges_are_found_in_blocks(spark):
    counts = spark.createDataFrame([("flaky_tests", "range", str(i * 37), 1 + i % 3) for i in range(2000)] + [("flaky_tests", "all", "", 9)], store.COUNTS)
    order = sorted(((i * 37, 1 + i % 3) for i in range(2000)), reverse=True)
    spots = [v for v, n in order for _ in range(n)]
    for start, stop in ((0, 10), (1234, 1244), (len(spots) - 3, len(spots) + 7)):
        place = index.find_rows(counts, "flaky_tests", start, stop)
        own = spots[start:stop]
        assert (place.low, place.high) == (min(own), max(own)) and place.before == spots.index(max(own))
    assert index.find_rows(counts, "flaky_tests", len(spots), len(spots) + 10) is None
