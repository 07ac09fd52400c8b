"""Connected components of an edge table, without gathering any of them.

Each task first runs union-find over its own edges, which leaves one edge per node. Then
large-star and small-star steps (Kiveris et al., 2014) alternate until all edges point from
a node to the smallest node of its component. A step is a minimum per node, summed up
before its shuffle and written, and a join of two plain tables, in which adaptive execution
splits nodes with many neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MOST_ROUNDS = 60


def find(parent: dict, x):
    """Root of x, halving the path on the way."""
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = x = parent.setdefault(up, up)
    return x


def unite(parent: dict, a, b) -> bool:
    """Join two sets below the smaller root; whether they were apart."""
    a, b = find(parent, a), find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)
    return a != b


def local_stars(edges: DataFrame) -> DataFrame:
    """(hi, lo) edges with the same components inside each task, one per node."""

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                unite(parent, a, b)
        rows = [(x, r) for x in list(parent) if (r := find(parent, x)) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["hi", "lo"]
        )

    return edges.mapInArrow(union, "hi long, lo long")


def ended(edges: DataFrame) -> bool:
    """Whether each node points to one other node at most, which points to none."""
    ends = edges.select(F.col("hi").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(
        edges.select("lo", F.lit(0), F.lit(1))
    )
    roles = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return roles.filter((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("into") == 1))).isEmpty()


def star_round(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select("lo", "hi"))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    large = cut(large, "large-star")
    lowest = cut(large.groupBy("hi").agg(F.min("lo").alias("m")), "lowest")
    moved = large.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return cut(moved.unionAll(lowest.select("hi", "m")).distinct(), "small-star")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes that are not the smallest of their component.

    ``edges`` has two columns of longs, in any order, with any repeats; no nulls.
    """
    a, b = edges.columns
    edges = cut(local_stars(edges.select(F.col(a).cast("bigint"), F.col(b).cast("bigint"))), "edges")
    for _ in range(MOST_ROUNDS):
        if ended(edges):
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
        edges = star_round(edges)
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
