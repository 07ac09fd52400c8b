"""The four stored tables as parquet batches with a manifest.

Layout below one root folder::

    <table>/batch=<id>/part-*.parquet
    failures/batch=<id>/day=<date>/part-*.parquet
    changes/batch=<id>/table_name=<table>/part-*.parquet
    counts/batch=<id>/part-*.parquet
    keys/batch=<id>/part-*.parquet
    manifest/batch=<id>/part-*.parquet     written last

Parquet has no commit over several tables. A batch counts only once its manifest row
exists, so a job that dies half-way leaves nothing visible, and writing a batch again
replaces its files (replays change nothing).

Failures are filed by the day of their creation, so trends read only their days; every
table is sorted by its failure's key inside its files, so lookups skip most of them.

Every batch has a version, the next whole number. A *change* (repairs applied, rows deleted) is
a batch of records (key, version, operation), written beside the rows: its size is that of the
change. Readers merge the last change of each key into rows of older versions. Every batch also
writes what it adds to the dashboard's counters, or takes from them, so these are read without
the tables. Key filters and counts per range (see ``index``) spare lookups and deep pages most
of the rows. A batch or change that is written again keeps its version and changes nothing.

*Compaction* writes a snapshot: all rows as one batch that opens the next epoch, without the
changes. Readers take the batches of the newest epoch; older ones stay until someone deletes
them. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import first_filled, make_id, percent_text
from . import index, schemas

DAY = "day"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables.

    It lies in the folder that ``spark.checkpoint.dir`` names, else below the session's
    warehouse; driver and executors share both.
    """
    return new_folder(shared_root(spark.conf.get), name)


def shared_root(setting) -> str:
    """The folder for intermediate tables; ``setting`` looks a session setting up."""
    root = setting("spark.checkpoint.dir", None)
    if not root:
        warehouse = setting("spark.sql.warehouse.dir", None)
        if not warehouse:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{warehouse.rstrip('/')}/_scratch"
    return root.rstrip("/")


def new_folder(root: str, name: str) -> str:
    return f"{root}/failscope-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table and read it back.

    Steps that use their input several times multiply its plan; after a few such steps
    planning alone would take hours. The written table also survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_rows(analyzed: DataFrame) -> dict[str, DataFrame]:
    """Triage result to the rows of the four tables.

    Failures and repairs for every row, flaky tests where the flag is set,
    notifications where an alert was sent. The failure's id is used in all tables.
    """
    names = analyzed.columns
    pattern = F.col("recent_pattern") if "recent_pattern" in names else F.lit("N/A")
    recent = F.col("recent") if "recent" in names else F.lit(None).cast("array<string>")
    created = F.col("created_at") if "created_at" in names else F.current_timestamp()
    failures = analyzed.select(
        "id", "test_id", "test_name", "pipeline",
        F.lit("FAIL").alias("status"),
        "root_cause",
        percent_text("confidence").alias("confidence"),
        F.col("healing.status").alias("healing"),
        first_filled("logs", default=F.col("error_message")).alias("logs"),
        "stack_trace",
        F.col("healing.recommendation").alias("recommendation"),
        F.col("healing.developer_alert").alias("developer_alert"),
        created.alias("created_at"),
    )
    # The error row's id is shared, so a stored repair gets an id of its own.
    own_id = F.when(F.col("healing.healing_id") == "H-ERROR", make_id("H", "test_id")).otherwise(
        F.col("healing.healing_id")
    )
    healing = analyzed.select(
        "id",
        own_id.alias("healing_id"),
        F.col("test_id").alias("failure_test_id"),
        "test_name",
        F.col("healing.repair_type").alias("repair_type"),
        F.col("healing.old_value").alias("old_value"),
        F.col("healing.new_value").alias("new_value"),
        F.col("healing.status").alias("status"),
    )
    flaky = analyzed.filter(F.col("flaky_analysis.is_flaky")).select(
        "id",
        F.col("test_id").alias("test_code"),
        "test_name",
        F.col("flaky_analysis.instability_score").alias("instability_score"),
        pattern.alias("recent_pattern"),
        F.col("flaky_analysis.risk_level").alias("risk_level"),
        F.col("flaky_analysis.flaky_probability").alias("score"),
        recent.alias("pattern"),
    )
    notes = analyzed.filter(F.col("notification").isNotNull()).select(
        "id",
        F.col("test_id").alias("failure_test_id"),
        "test_name",
        "root_cause",
        F.col("notification.message").alias("message"),
        F.col("notification.target").alias("target"),
    )
    return {"failures": failures, "healing_actions": healing, "flaky_tests": flaky, "notifications": notes}


def persist_fanout(analyzed: DataFrame, root: str, batch: str, cache: bool = True) -> None:
    """Write one analyzed batch into the four tables, then its manifest row.

    The batch is analyzed once and kept while its four tables are written; ``cache=False``
    analyzes it once per table instead, for batches larger than the executors' disks.
    """
    if cache:
        analyzed = analyzed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        spark = analyzed.sparkSession
        place = state(spark, root, batch)
        write_batch(table_rows(analyzed), root, batch, place.own_epoch, place.own_version)
    finally:
        if cache:
            analyzed.unpersist()


def write_batch(tables: dict[str, DataFrame], root: str, batch: str, epoch: int, version: int) -> None:
    for name, rows in tables.items():
        path, key = f"{root}/{name}/batch={batch}", schemas.FAILURE_KEYS[name]
        if name == "failures":
            # Rebalancing brings the rows of a day together, and splits large days.
            rows = rows.withColumn(DAY, F.to_date("created_at")).hint("rebalance", DAY)
            rows.sortWithinPartitions(DAY, key).write.mode("overwrite").partitionBy(DAY).parquet(path)
        else:
            rows.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    spark = next(iter(tables.values())).sparkSession
    written = {name: spark.read.schema(df.schema).parquet(f"{root}/{name}/batch={batch}") for name, df in tables.items()}
    write_counts(written, root, batch)
    own = spark.read.schema(COUNTS).parquet(f"{root}/counts/batch={batch}").filter(F.col("dimension") == "all")
    index.write_filters(written, {r["table_name"]: r["n"] for r in own.collect()}, root, batch)
    commit(spark, root, batch, epoch, version, "rows")


def commit(spark: SparkSession, root: str, batch: str, epoch: int, version: int, kind: str) -> None:
    done = spark.range(1).select(
        F.current_timestamp().alias("written_at"), F.lit(epoch).alias("epoch"),
        F.lit(version).cast("bigint").alias("version"), F.lit(kind).alias("kind"),
    )
    done.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/batch={batch}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per batch. Stores older than versions have none: their batches come first."""
    schema = "written_at timestamp, epoch int, version bigint, kind string, batch string"
    rows = spark.read.schema(schema).parquet(f"{root}/manifest")
    return rows.withColumns({"version": F.coalesce("version", F.lit(0)), "kind": F.coalesce("kind", F.lit("rows"))})


@dataclass
class State:
    """What the manifest says: newest epoch, whether it has changes, and the place of a batch to write."""

    epoch: int = 0
    changed: bool = False
    own_epoch: int = 0
    own_version: int = 1
    known: bool = False


def state(spark: SparkSession, root: str, batch: str | None = None) -> State:
    """One small aggregation. A batch that is there already keeps its epoch and version."""
    try:
        rows = manifest(spark, root)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return State()
        raise
    mine = F.col("batch") == F.lit(batch)
    last = F.max(F.when(F.col("kind") == "changes", F.col("epoch")))
    r = rows.agg(F.max("epoch").alias("epoch"), last.alias("last"), F.max("version").alias("version"),
                 F.max(F.when(mine, F.col("epoch"))).alias("own"), F.max(F.when(mine, F.col("version"))).alias("own_version")).first()
    epoch, known = r["epoch"] or 0, r["own"] is not None
    return State(epoch, r["last"] == epoch and r["last"] is not None, r["own"] if known else epoch,
                 r["own_version"] if known else (r["version"] or 0) + 1, known)


def current_epoch(spark: SparkSession, root: str) -> int:
    """Number of the newest epoch; 0 for a store that does not exist yet."""
    return state(spark, root).epoch


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of one table in the newest epoch, changes applied. The batch list prunes the folders to read."""
    return _scan(spark, root, name).drop(DAY)


def scan_keys(spark: SparkSession, root: str, name: str, keys: DataFrame, key: str = "test_id") -> DataFrame:
    """Rows of one table that belong to some keys; batches whose filter holds none of them are not read."""
    own = schemas.FAILURE_KEYS[name]
    asked = keys.select(F.col(key).alias(own)).distinct()
    done = manifest(spark, root).filter((F.col("epoch") == current_epoch(spark, root)) & (F.col("kind") == "rows"))
    names = index.batches_with(spark, root, name, asked, done)
    return _scan(spark, root, name, names).drop(DAY).join(asked, own, "left_semi").select(*schemas.TABLES[name].names)


def page(spark: SparkSession, root: str, name: str, number: int = 1, size: int = 10) -> DataFrame:
    """A page of one table, newest rows first, with the page number, page size and the total in every row.

    Only the ranges that the counters place the page in are read and sorted, however deep it lies.
    """
    counts, start = counters(spark, root), (number - 1) * size
    known = {r["dimension"]: r["n"] for r in counts.filter((F.col("table_name") == name) & F.col("dimension").isin("all", index.RANGE))
             .groupBy("dimension").agg(F.sum("n").alias("n")).collect()}
    total = known.get("all", 0)
    whole = known.get(index.RANGE, 0) != total
    place = None if whole else index.find_rows(counts, name, start, start + size)
    rows = _scan(spark, root, name)
    if place:
        rows = rows.filter(index.within(name, place))
        if name == "failures":
            rows = rows.filter(index.days_within(place, DAY))
    elif not whole:
        rows = rows.filter(F.lit(False))
    order = [F.desc("created_at")] if name == "failures" else []
    rows = rows.drop(DAY).orderBy(*order, F.desc("id")).offset(start - place.before if place else start).limit(size)
    return rows.withColumns({"total": F.lit(total).cast("bigint"), "page": F.lit(number), "page_size": F.lit(size)})


def _scan(spark: SparkSession, root: str, name: str, batches: list[str] | None = None) -> DataFrame:
    """Rows with their day, of the named batches or all."""
    schema = StructType(list(schemas.TABLES[name].fields)).add("batch", "string")
    rows = spark.read.schema(schema.add(DAY, "date") if name == "failures" else schema).parquet(f"{root}/{name}")
    if batches is not None:
        rows = rows.filter(F.col("batch").isin(batches))
    now = state(spark, root)
    done = manifest(spark, root).filter(F.col("epoch") == now.epoch)
    columns = [c for c in rows.columns if c != "batch"]
    if not now.changed:
        return rows.join(done.select("batch"), "batch", "left_semi").drop("batch")
    merged = changes(spark, root, name, now.epoch)
    rows = rows.join(done.select("batch", "version"), "batch").join(merged, rows["id"] == F.col("_id"), "left")
    for c in schemas.CHANGEABLE.get(name, ()):
        newer = F.coalesce(F.col(f"_{c}.version") > F.col("version"), F.lit(False))
        rows = rows.withColumn(c, F.when(newer, F.col(f"_{c}.value")).otherwise(F.col(c)))
    gone = F.coalesce(F.col("_deleted") > F.col("version"), F.lit(False))
    return rows.filter(~gone).select(*columns)


def changes(spark: SparkSession, root: str, name: str, epoch: int) -> DataFrame:
    """One row per changed key: the version of its last deletion, and each column's last value with its version.

    A row of a constant size per key, whatever the number of changes; sums up before its shuffle.
    """
    schema = "id bigint, operation string, status string, healing string, batch string, table_name string"
    records = spark.read.schema(schema).parquet(f"{root}/changes").filter(F.col("table_name") == name)
    done = manifest(spark, root).filter((F.col("epoch") == epoch) & (F.col("kind") == "changes")).select("batch", "version")
    last = [
        F.max(F.when(F.col(c).isNotNull(), F.struct("version", F.col(c).alias("value")))).alias(f"_{c}")
        for c in schemas.CHANGEABLE.get(name, ())
    ]
    deleted = F.max(F.when(F.col("operation") == "delete", F.col("version"))).alias("_deleted")
    return records.join(done, "batch").groupBy(F.col("id").alias("_id")).agg(deleted, *last)


def write_changes(records: dict[str, DataFrame], root: str, batch: str, lost: dict[str, DataFrame] | None = None) -> bool:
    """Write (id, operation, status, healing) records by table as one change; False if it was there.

    ``lost`` holds the rows that the change deletes, which the counters give up.
    """
    spark = next(iter(records.values())).sparkSession
    place = state(spark, root, batch)
    if place.known:
        return False
    every = [df.select("id", "operation", "status", "healing", F.lit(name).alias("table_name")) for name, df in records.items()]
    folder = f"{root}/changes/batch={batch}"
    reduce(DataFrame.unionByName, every).write.mode("overwrite").partitionBy("table_name").parquet(folder)
    write_counts(lost or {}, root, batch, -1, spark)
    commit(spark, root, batch, place.own_epoch, place.own_version, "changes")
    return True


COUNTS = "table_name string, dimension string, value string, n bigint"


def write_counts(tables: dict[str, DataFrame], root: str, batch: str, sign: int = 1, spark: SparkSession | None = None) -> None:
    """What these rows add to the counters: a few rows per table, and one per day and range."""
    parts = []
    for name, df in tables.items():
        by = {"all": F.lit("")}
        if name == "failures":
            by |= {"root_cause": F.col("root_cause"), DAY: F.date_format("created_at", "yyyy-MM-dd")}
        if name == "flaky_tests":
            by["risk_level"] = F.lower("risk_level")
        by[index.RANGE] = index.range_of(name)
        each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in by.items()])).alias("c")
        parts.append(df.select(each).groupBy("c.dimension", "c.value").agg((F.count(F.lit(1)) * sign).alias("n"))
                     .select(F.lit(name).alias("table_name"), "dimension", "value", "n"))
    spark = spark or next(iter(tables.values())).sparkSession
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], COUNTS)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/counts/batch={batch}")


def counters(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, dimension, value, n) of the newest epoch, zeros left out. Reads no table."""
    rows = spark.read.schema(f"{COUNTS}, batch string").parquet(f"{root}/counts")
    done = manifest(spark, root).filter(F.col("epoch") == current_epoch(spark, root)).select("batch")
    sums = rows.join(done, "batch", "left_semi").groupBy("table_name", "dimension", "value").agg(F.sum("n").alias("n"))
    return sums.filter("n <> 0")


def failures_of_days(spark: SparkSession, root: str, first: str, last: str) -> DataFrame:
    """Failures created between two dates; other days' folders are not read."""
    return _scan(spark, root, "failures").filter(F.col(DAY).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).drop(DAY)


def write_snapshot(tables: dict[str, DataFrame], spark: SparkSession, root: str) -> int:
    """Write the given tables, and the others as they are, as the next epoch; its number.

    The tables may be read from the store itself, as a snapshot never touches older files.
    """
    place = state(spark, root)
    epoch = place.epoch + 1
    whole = {name: tables[name] if name in tables else scan_table(spark, root, name) for name in schemas.TABLES}
    whole = {name: df.select(*schemas.TABLES[name].names) for name, df in whole.items()}
    write_batch(whole, root, f"snapshot-{epoch:09d}", epoch, place.own_version)
    return epoch


def compact(spark: SparkSession, root: str) -> int:
    """All batches and changes of the newest epoch as one batch."""
    return write_snapshot({}, spark, root)


def add_created_at(df: DataFrame, load_time, column: str = "created_at") -> DataFrame:
    """Give old rows, or tables without the column, the load time."""
    stamp = F.lit(load_time).cast("timestamp")
    value = F.coalesce(F.col(column).cast("timestamp"), stamp) if column in df.columns else stamp
    return df.withColumn(column, value)
