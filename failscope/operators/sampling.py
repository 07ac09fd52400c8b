"""Reproducible sampling: class caps, splits, orders. All draws are hashes of row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw, draw_below
from .parallel import few_values, per_group

PREFIX_DIGITS = 4


def lowest_draws(
    df: DataFrame, group: str, key: str, seed: str, quota: DataFrame | Column,
    classes: list | None = None,
) -> DataFrame:
    """Mark, per group, the rows with the ``quota`` lowest draws: adds ``_chosen``.

    A plain rank over the group would pull a group that holds a third of the table
    into one task. Instead:

    1. count the draws by group and first hex digits (partial aggregation);
    2. a running sum over these counts tells which prefix the quota falls into;
    3. only keys with that prefix, 1 in 65,536 of the group, are ranked, which gives
       the exact last draw that is still chosen;
    4. the full rows are compared with that bound.

    Steps 1 to 3 read the group and key columns only. The bounds have one row per
    group; if the groups are few they are broadcast, so full rows are never shuffled.
    Rows without a group form a group of their own; no row is dropped. ``classes`` states
    the groups, which saves looking them up. ``quota`` is a number column, or a frame
    (group, quota) with one row per group.
    """
    classes = few_values(df, group) if classes is None else classes
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("none")).alias("_group")
    keys = df.select(
        named, F.struct(draw(seed, key).alias("d"), F.col(key).alias("k")).alias("_draw")
    ).withColumn("_prefix", F.substring("_draw.d", 1, PREFIX_DIGITS))
    counts = keys.groupBy("_group", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(quota, DataFrame):
        counts = counts.join(per_group(quota.select(named, F.col("quota").alias("_quota")), classes), "_group")
    else:
        counts = counts.withColumn("_quota", quota)
    along = Window.partitionBy("_group").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    over = F.col("_sum") > F.col("_quota")
    cuts = (
        counts.withColumn("_sum", F.sum("_n").over(along))
        .groupBy("_group")
        .agg(
            F.min(F.when(over, F.col("_prefix"))).alias("_cut"),
            F.coalesce(F.max(F.when(~over, F.col("_sum"))), F.lit(0)).alias("_below"),
            F.first("_quota").alias("_quota"),
        )
    )
    in_order = Window.partitionBy("_group", "_prefix").orderBy("_draw")
    last = (
        keys.join(per_group(cuts, classes), "_group")
        .filter(F.col("_prefix") == F.col("_cut"))
        .withColumn("_rank", F.row_number().over(in_order))
        .filter(F.col("_rank") == F.col("_quota") - F.col("_below"))
        .select("_group", F.col("_draw").alias("_last"))
    )
    bounds = cuts.join(per_group(last, classes), "_group", "left").select("_group", "_cut", "_last")
    own = F.struct(draw(seed, key).alias("d"), F.col(key).alias("k"))
    prefix = F.substring(draw(seed, key), 1, PREFIX_DIGITS)
    chosen = F.col("_cut").isNull() | (prefix < F.col("_cut")) | F.coalesce(own <= F.col("_last"), F.lit(False))
    return (
        df.withColumn("_group", named)
        .join(per_group(bounds, classes), "_group")
        .withColumn("_chosen", chosen)
        .select(*df.columns, "_chosen")
    )


def cap_per_class(
    df: DataFrame, label: str, key: str, cap: int = 2000, seed: str = "cap",
    classes: list | None = None,
) -> DataFrame:
    """At most ``cap`` rows per label, the same ones on every run.

    With ``classes``, rows of other labels or none are left out.
    """
    if classes is not None:
        df = df.filter(F.col(label).isin(list(classes)))
    return lowest_draws(df, label, key, seed, F.lit(cap), classes).filter("_chosen").drop("_chosen")


def seeded_shuffle(df: DataFrame, key: str, seed: str = "shuffle") -> DataFrame:
    """Reproducible random order."""
    return df.orderBy(draw(seed, key), key)


def stratified_split(
    df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: str = "split",
    exact: bool = True, classes: list | None = None,
) -> DataFrame:
    """Add ``side`` ("train" / "test") to every row.

    Exact: the test side gets the rounded share of every label. Otherwise a draw
    decides row by row, without any shuffle, and the share holds approximately.
    """
    if not exact:
        hit = draw_below(seed, key, test_share)
        return df.withColumn("side", F.when(hit, "test").otherwise("train"))
    quota = df.groupBy(label).agg(
        F.floor(F.count(F.lit(1)) * F.lit(test_share) + F.lit(0.5)).cast("bigint").alias("quota")
    )
    marked = lowest_draws(df, label, key, seed, quota, classes)
    return marked.withColumn("side", F.when(F.col("_chosen"), "test").otherwise("train")).drop("_chosen")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: n / (classes * count)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    n = counts.agg(F.sum("count").alias("n")).scalar()
    k = counts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("weight", n / (k * F.col("count")))
