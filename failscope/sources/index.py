"""Indexes beside a store's batches: which keys a batch may hold, and how many rows a range holds.

*Key filters.* Every batch writes, per table, a Bloom filter of the keys its rows belong to, as
rows of 32,768 bits, so that a filter of any size is a table, written and probed by joins. A
lookup reads only batches whose filter holds one of its keys; a batch without a filter (empty, or
written before there were any) is always read. A filter never misses a key that is there.

*Ranges.* Counters hold the rows per hour of creation (failures) or per 65,536 ids (the other
tables), negative for deletions. Prefix sums of them name the ranges a page lies in; only these
are read and sorted. A store whose counters lack ranges is paged whole.

Cases: null keys are never found; keys asked for twice count once; empty tables have no filter
and no page; rows without a time come after all others.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas

#: Bits of a row: what ``bitmap_construct_agg`` makes.
SLOT = 32_768
HASHES = 4
BITS_PER_KEY = 12
#: More keys than this are joined with the whole table, as they would hit every batch.
PROBE_KEYS = 100_000
#: Most batches named in a plan; with more hits the table is read whole.
NAMED_BATCHES = 10_000
FILTERS = "table_name string, size bigint, slot bigint, bits binary"

RANGE = "range"
ID_BITS = 16
HOUR = 3600
#: Ranges summed up first, as a power of two.
COARSE_BITS = 12
#: Range of rows without a time.
NO_TIME = -(1 << 40)


def slots_for(rows: int) -> int:
    """Rows of a filter: a power of two, so that filters have few sizes."""
    need = max(1, -(-rows * BITS_PER_KEY // SLOT))
    return 1 << (need - 1).bit_length()


def positions(key: Column, sizes: list[int]) -> Column:
    """The bits of a key in filters of each size."""
    out = []
    for size in sizes:
        for i in range(HASHES):
            at = F.pmod(F.xxhash64(F.lit(i), key), F.lit(size * SLOT))
            out.append(F.struct(
                F.lit(size).cast("bigint").alias("size"),
                F.shiftright(at, 15).alias("slot"),
                F.pmod(at, F.lit(SLOT)).cast("bigint").alias("bit"),
            ))
    return F.array(*out)


def write_filters(tables: dict[str, DataFrame], sizes: dict[str, int], root: str, batch: str) -> None:
    """The filters of one batch. Keys are made distinct first, so no slot is hot; bits meet after their shuffle."""
    folder = f"{root}/keys/batch={batch}"
    tables = {name: df for name, df in tables.items() if sizes.get(name)}
    spark_rows = None
    for name, df in tables.items():
        key = schemas.FAILURE_KEYS[name]
        bits = df.select(key).na.drop().distinct().select(F.explode(positions(F.col(key), [slots_for(sizes[name])])).alias("p"))
        rows = bits.select("p.*").repartition("size", "slot").groupBy("size", "slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
        rows = rows.select(F.lit(name).alias("table_name"), "size", "slot", "bits")
        spark_rows = rows if spark_rows is None else spark_rows.unionByName(rows)
    if spark_rows is not None:
        spark_rows.sortWithinPartitions("table_name", "slot").write.mode("overwrite").parquet(folder)


def read_filters(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    try:
        rows = spark.read.schema(f"{FILTERS}, batch string").parquet(f"{root}/keys")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows.filter(F.col("table_name") == name)


def hits(filters: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(key, batch): the batches that may hold a key."""
    sizes = sorted(r[0] for r in filters.select("size").distinct().collect())  # powers of two: a few dozen at most
    if not sizes:
        return filters.join(keys.select(key), F.lit(False)).select(key, "batch")
    asked = keys.select(key).na.drop().distinct().select(key, F.explode(positions(F.col(key), sizes)).alias("p")).select(key, "p.*")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = asked.join(filters, ["size", "slot"]).filter(F.getbit(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1)
    return held.groupBy(key, "batch").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == HASHES).select(key, "batch")


def batches_with(spark: SparkSession, root: str, name: str, keys: DataFrame, done: DataFrame) -> list[str] | None:
    """Names of the batches to read for some keys of a table; None if that is no help.

    ``keys`` has the table's key column, ``done`` the batches that count.
    """
    key = schemas.FAILURE_KEYS[name]
    filters = read_filters(spark, root, name)
    if filters is None or keys.limit(PROBE_KEYS + 1).count() > PROBE_KEYS:
        return None
    covered = filters.select("batch").distinct()
    wanted = (
        done.select("batch").join(covered, "batch", "left_anti")
        .unionByName(hits(filters, keys, key).select("batch")).distinct().limit(NAMED_BATCHES + 1)
    )
    names = [r[0] for r in wanted.collect()]
    return None if len(names) > NAMED_BATCHES else sorted(names)


def range_of(name: str) -> Column:
    """The range a row of a table is counted in, as text."""
    if name == "failures":
        return F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / F.lit(HOUR * 1_000_000)).cast("string")
    return F.shiftright("id", ID_BITS).cast("string")


class Place(NamedTuple):
    """Ranges that hold the rows asked for, and how many rows come before them."""

    low: int
    high: int
    before: int


def find_rows(counts: DataFrame, name: str, start: int, stop: int) -> Place | None:
    """Where the rows at places ``start`` to ``stop`` of falling ranges lie; None if there are none.

    Ranges are summed up in blocks first, so that no task orders more than the blocks, or the
    ranges of the blocks found.
    """
    rows = counts.filter((F.col("table_name") == name) & (F.col("dimension") == RANGE))
    rows = rows.select(F.coalesce(F.col("value").cast("bigint"), F.lit(NO_TIME)).alias("value"), "n")
    before = 0
    for bits in (COARSE_BITS, 0):
        block = F.shiftright("value", bits)
        upto = F.sum("n").over(Window.orderBy(F.desc("block"))) + F.lit(before)
        sums = rows.groupBy(block.alias("block")).agg(F.sum("n").alias("n")).withColumn("upto", upto)
        found = sums.filter((F.col("upto") > start) & (F.col("upto") - F.col("n") < stop)).agg(
            F.min("block").alias("low"), F.max("block").alias("high"), F.min(F.col("upto") - F.col("n")).alias("before")
        ).first()
        if found["low"] is None:
            return None
        before = found["before"]
        rows = rows.filter(block.between(found["low"], found["high"]))
    return Place(found["low"], found["high"], before)


def within(name: str, place: Place) -> Column:
    """The filter that keeps the rows of the ranges found; it reaches the scan."""
    if name != "failures":
        return F.col("id").between(place.low << ID_BITS, ((place.high + 1) << ID_BITS) - 1)
    rows = F.col("created_at") < F.timestamp_seconds(F.lit((place.high + 1) * HOUR))
    if place.low == NO_TIME:
        return F.coalesce(rows, F.lit(True)) if place.high != NO_TIME else F.col("created_at").isNull()
    return rows & (F.col("created_at") >= F.timestamp_seconds(F.lit(place.low * HOUR)))


def days_within(place: Place, day: str) -> Column:
    """The folders of these ranges, a day more on both sides whatever the session's time zone."""
    if place.low == NO_TIME:
        return F.lit(True)
    first, last = (F.to_date(F.timestamp_seconds(F.lit(h * HOUR))) for h in (place.low, place.high + 1))
    return F.col(day).between(F.date_sub(first, 1), F.date_add(last, 1))
