"""Partition counts and size checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 1000


def spread(df: DataFrame, key: str) -> DataFrame:
    """At least one partition per core for work that is heavy per row.

    A small file comes as one partition and would keep one core busy. Inputs with
    enough partitions, that is all large ones, are returned as they are. Rows only move;
    results do not depend on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def few_values(df: DataFrame, column: str, limit: int = FEW) -> list | None:
    """The distinct values of a column if there are at most ``limit``, else None.

    Reads one column, counts in the tasks, and takes at most ``limit`` + 1 values.
    """
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else [r[0] for r in rows]


def per_group(df: DataFrame, groups: list | None) -> DataFrame:
    """A table with one row per group: broadcast if the groups are known to be few.

    Otherwise Spark chooses the join, and splits hot groups while it runs.
    """
    return df if groups is None or len(groups) > FEW else F.broadcast(df)
