"""Sharding: whole groups to the least loaded shard, longest first.

A group is all rows with one text. Longest-processing-time scheduling takes items by
falling size and gives each to the shard with the smallest load, held in a heap.

At scale there are far too many groups for one heap, so only *items* are scheduled:

- a group of at least ``total / (shards * FINE)`` bytes is an item of its own; there can be
  no more than ``shards * FINE`` of them;
- all others are dealt by a hash of their text into ``shards * BUNDLES`` bundles, and each
  bundle is an item.

The heap thus sees at most ``shards * (FINE + BUNDLES)`` items at any input size, and no
bundle is so large that it unbalances a shard. Everything else is narrow work, a grouping
that is summed before its shuffle, and joins with those items.

Cases: a null text counts as a group of its own kind, of size 1 per row, kept together;
an empty text is a group like any other. Repeated rows are placed like the row they
repeat and get a slot each. An empty table gives an empty result. Columns of the input
named like a result column are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, without

FINE = 1024
BUNDLES = 512
SLICE_ROWS = 50_000
LEAST_SLICES = 64
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def group_key(text: Column) -> Column:
    """SHA-256 of the text; rows without a text share a key that no text has."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit("no text").cast("binary"))


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def longest_first(items: list[tuple[int, str]], shards: int) -> list[tuple[str, int]]:
    """Items as (size, name). Ties go by name and by shard number, so that a rerun agrees."""
    heap = [(0, shard) for shard in range(shards)]
    placed = []
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed.append((name, shard))
        heapq.heappush(heap, (load + size, shard))
    return placed


def plan_items(sizes: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, int]:
    """(placement of every item, all groups, the size from which a group is an item).

    ``sizes`` has (group, size) rows, one or more for each group.
    """
    groups = cut(sizes.groupBy("group").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    heavy = max(1, -(-total // (shards * FINE)))
    items = groups.groupBy(item_name(heavy, shards).alias("item")).agg(F.sum("size").alias("size"))
    placed = longest_first([(r["size"], r["item"]) for r in items.collect()], shards)
    spark = sizes.sparkSession
    return spark.createDataFrame(placed, "item string, shard int"), groups, heavy


def item_name(heavy: int, shards: int) -> Column:
    bundle = F.pmod(F.xxhash64("group"), F.lit(shards * BUNDLES))
    return F.when(F.col("size") >= heavy, F.concat(F.lit("g"), F.hex("group"))).otherwise(
        F.concat(F.lit("b"), bundle.cast("string"))
    )


def assign(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    ``slot`` numbers a shard's rows from 0 without gaps. Rows of a shard are dealt by a
    hash of their key into slices, numbered inside their slice, and moved up by what the
    slices before it hold, so no task orders a whole shard. ``grown_shard`` is null, as
    the law is "bytes".
    """
    docs = without(docs, *OWN, "_group", "_item", "_slice", "_start")
    rows = docs.withColumns({
        "size": row_size(F.col(text)),
        "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")),
        "_group": group_key(F.col(text)),
    })
    placed, groups, heavy = plan_items(rows.select(F.col("_group").alias("group"), "size"), shards)
    # At most shards * FINE rows, whatever the input.
    large = F.broadcast(groups.filter(F.col("size") >= heavy).select(
        F.col("group").alias("_group"), F.concat(F.lit("g"), F.hex("group")).alias("_item")
    ))
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("_group"), F.lit(shards * BUNDLES)).cast("string"))
    # At most shards * (FINE + BUNDLES) rows.
    where = F.broadcast(placed.withColumnRenamed("item", "_item"))
    rows = (
        rows.join(large, "_group", "left")
        .withColumn("_item", F.coalesce("_item", bundle))
        .join(where, "_item", "left")
        .drop("_item")
    )
    return number(rows, shards, key).select(
        *docs.columns, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def number(rows: DataFrame, shards: int, key: str) -> DataFrame:
    """Slots inside shards. Equal rows may change places, which no column shows."""
    n = rows.select("shard").groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    slices = max(LEAST_SLICES, -(-n // SLICE_ROWS))
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(F.col(key), "text_crc32"), F.lit(slices)))
    counts = rows.groupBy("shard", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_slice").orderBy(F.col(key), "text_crc32")
    return (
        rows.join(starts, ["shard", "_slice"])
        .withColumn("slot", F.row_number().over(inside) - 1 + F.col("_start"))
        .drop("_slice", "_start")
    )
