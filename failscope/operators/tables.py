"""Lookups, joins and changes of the stored tables.

Changes of tables return new tables; ``store_`` forms write change records into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import schemas, store


def lookup_failure(failures: DataFrame, test_id: str) -> DataFrame:
    return failures.filter(F.col("test_id") == test_id)


def lookup_failures(failures: DataFrame, keys: DataFrame) -> DataFrame:
    """Batch form of the point lookup."""
    return failures.join(keys, "test_id", "left_semi")


def missing_keys(keys: DataFrame, table: DataFrame, key: str = "test_id") -> DataFrame:
    """Keys asked for that the table does not hold."""
    return keys.select(key).distinct().join(table.select(key), key, "left_anti")


def incident_view(
    failures: DataFrame, healing: DataFrame, flaky: DataFrame, notes: DataFrame
) -> DataFrame:
    """One row per failure with its repair, flaky and notification rows as structs.

    The side tables are joined on the failure's key, which is unique in each of them
    as ``persist_fanout`` writes at most one row per failure.
    """
    def side(df, key, name, fields):
        return df.select(F.col(key).alias("test_id"), F.struct(*fields).alias(name))

    return (
        failures.join(
            side(healing, "failure_test_id", "repair",
                 ["healing_id", "repair_type", "old_value", "new_value", "status"]), "test_id", "left")
        .join(side(flaky, "test_code", "flaky", ["instability_score", "risk_level"]), "test_id", "left")
        .join(side(notes, "failure_test_id", "notification", ["message", "target"]), "test_id", "left")
    )


def append_rows(existing: DataFrame, incoming: DataFrame, table: str = "failures") -> DataFrame:
    """Rows of ``incoming`` that may be inserted: complete, and new by unique key.

    A required column that ``incoming`` lacks is an error; rows that leave one empty are
    left out. Of several new rows with one key the lowest id is kept. The rank filter turns into
    a group limit below the shuffle, so a key with very many copies stays cheap.
    """
    schema = schemas.TABLES[table]
    required = [f.name for f in schema.fields if not f.nullable]
    absent = sorted(set(required) - set(incoming.columns))
    if absent:
        raise ValueError(f"{table}: required columns are missing: {', '.join(absent)}")
    complete = incoming.na.drop("any", subset=required)
    key = schemas.UNIQUE_KEYS.get(table)
    if key is None:
        return complete
    first = Window.partitionBy(key).orderBy("id")
    single = (
        complete.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")
    )
    return single.join(existing.select(key), key, "left_anti").select(*incoming.columns)


def apply_heal(
    failures: DataFrame, healing: DataFrame, keys: DataFrame, only_suggested: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Mark failures as healed: (new failures, new healing actions).

    The failure becomes HEALED / Applied and its first repair (lowest id) Applied.
    ``only_suggested`` adds the dashboard's guard, which offers the action for
    suggested repairs only.
    """
    wanted = keys.select("test_id").distinct()
    if only_suggested:
        wanted = wanted.join(failures.filter(F.col("healing") == "Suggested"), "test_id", "left_semi")
    else:
        wanted = wanted.join(failures, "test_id", "left_semi")
    marked = wanted.withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull()
    new_failures = (
        failures.join(marked, "test_id", "left")
        .withColumns(
            {
                "status": F.when(hit, "HEALED").otherwise(F.col("status")),
                "healing": F.when(hit, "Applied").otherwise(F.col("healing")),
            }
        )
        .select(*failures.columns)
    )
    first = (
        healing.join(wanted.withColumnRenamed("test_id", "failure_test_id"), "failure_test_id", "left_semi")
        .groupBy("failure_test_id")
        .agg(F.min("id").alias("id"))
        .select("id", F.lit(True).alias("_hit"))
    )
    new_healing = (
        healing.join(first, "id", "left")
        .withColumn("status", F.when(hit, "Applied").otherwise(F.col("status")))
        .select(*healing.columns)
    )
    return new_failures, new_healing


def _record(operation: str, status: str | None = None, healing: str | None = None) -> list:
    return [F.lit(v).cast("string").alias(n) for n, v in (("operation", operation), ("status", status), ("healing", healing))]


def store_heal(spark: SparkSession, root: str, keys: DataFrame, batch: str, only_suggested: bool = False) -> bool:
    """``apply_heal`` in a store, as a change that holds the healed keys only.

    False if the change ``batch`` was made before; then nothing is written.
    """
    if store.state(spark, root, batch).known:
        return False
    failures, healing = (store.scan_table(spark, root, n) for n in ("failures", "healing_actions"))
    asked = keys.select("test_id").distinct()
    found = failures.join(asked, "test_id", "left_semi")
    if only_suggested:
        wanted = found.filter(F.col("healing") == "Suggested").select("test_id").distinct()
        found = found.join(wanted, "test_id", "left_semi")
    found = store.cut(found.select("id", "test_id"), "healed")
    first = (
        healing.join(found.select(F.col("test_id").alias("failure_test_id")).distinct(), "failure_test_id", "left_semi")
        .groupBy("failure_test_id").agg(F.min("id").alias("id"))
    )
    return store.write_changes({
        "failures": found.select("id", *_record("set", "HEALED", "Applied")),
        "healing_actions": first.select("id", *_record("set", "Applied")),
    }, root, batch)


def store_delete(spark: SparkSession, root: str, keys: DataFrame, batch: str) -> bool:
    """``delete_cascade`` in a store, as a change that holds the keys of deleted rows only."""
    if store.state(spark, root, batch).known:
        return False
    tables = {name: store.scan_table(spark, root, name) for name in schemas.TABLES}
    known = keys.select("test_id").distinct().join(tables["failures"], "test_id", "left_semi")
    known = store.cut(known, "deleted")
    gone = {}
    for name, df in tables.items():
        key = schemas.FAILURE_KEYS[name]
        gone[name] = df.join(known.select(F.col("test_id").alias(key)), key, "left_semi")
    return _lose(gone, root, batch)


def store_delete_one(spark: SparkSession, root: str, name: str, keys: DataFrame, key: str, batch: str) -> bool:
    """``delete_one`` in a store, as a change."""
    if store.state(spark, root, batch).known:
        return False
    return _lose({name: store.scan_table(spark, root, name).join(keys.select(key), key, "left_semi")}, root, batch)


def _lose(gone: dict[str, DataFrame], root: str, batch: str) -> bool:
    counted = ("id", "root_cause", "created_at", "risk_level")
    gone = {n: store.cut(df.select(*[c for c in counted if c in df.columns]), "gone") for n, df in gone.items()}
    return store.write_changes({n: df.select("id", *_record("delete")) for n, df in gone.items()}, root, batch, gone)


def store_lookup(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """``lookup_failures`` in a store; batches that cannot hold a key are not read."""
    return store.scan_keys(spark, root, "failures", keys)


def store_missing(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """``missing_keys`` in a store."""
    return missing_keys(keys, store.scan_keys(spark, root, "failures", keys))


def store_new_rows(spark: SparkSession, root: str, incoming: DataFrame, table: str = "failures") -> DataFrame:
    """``append_rows`` against a store: only batches that may hold an incoming key are read."""
    key = schemas.UNIQUE_KEYS.get(table)
    if key == schemas.FAILURE_KEYS[table]:
        existing = store.scan_keys(spark, root, table, incoming, key)
    else:
        existing = store.scan_table(spark, root, table)
    return append_rows(existing, incoming, table)


def delete_cascade(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """Remove failures and everything tied to them; one anti join per table.

    Side rows go only if the failure itself exists, as an unknown key is an error.
    """
    known = keys.select("test_id").distinct().join(tables["failures"], "test_id", "left_semi")
    out = {}
    for name, df in tables.items():
        key = schemas.FAILURE_KEYS[name]
        out[name] = df.join(known.select(F.col("test_id").alias(key)), key, "left_anti").select(*df.columns)
    return out


def delete_one(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Remove rows by the table's own key (healing_id, test_code or notification id)."""
    return df.join(keys.select(key), key, "left_anti").select(*df.columns)
