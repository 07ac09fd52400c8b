"""Flakiness per failure and outcome history per test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flaky
from ..functions.columns import percent_text_cut


def check_flaky(df: DataFrame, into: str = "flaky_analysis") -> DataFrame:
    """Add the struct column ``into`` with score, risk and flag of every row.

    A row without retry count, severity or duration cannot be scored and gets the
    ``Unknown`` row.
    """
    score = flaky.instability_score(
        "retry_count", "failure_type", "failure_stage", "severity", "test_duration_sec"
    )
    known = F.col("_score").isNotNull()
    result = F.struct(
        F.coalesce(flaky.is_flaky("_score"), F.lit(False)).alias("is_flaky"),
        F.coalesce("_score", F.lit(0.0)).alias("flaky_probability"),
        F.when(known, flaky.risk_level("_score")).otherwise("Unknown").alias("risk_level"),
        F.when(known, percent_text_cut("_score")).otherwise("0%").alias("instability_score"),
    )
    return df.withColumn("_score", score).withColumn(into, result).drop("_score")


def recent_pattern(
    df: DataFrame,
    test: str = "test_name",
    time: str = "created_at",
    tie: str = "id",
    outcome: str = "outcome",
    last: int = 5,
) -> DataFrame:
    """Last outcomes of every test, oldest first: (test, recent array, recent_pattern text).

    The rank filter becomes a group limit below the shuffle, so every task sends at
    most ``last`` rows per test, however hot the test is.
    """
    newest = Window.partitionBy(test).orderBy(F.desc(time), F.desc(tie))
    kept = (
        df.select(test, time, tie, outcome)
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= last)
    )
    ordered = F.array_sort(F.collect_list(F.struct(time, tie, outcome)))
    return (
        kept.groupBy(test)
        .agg(F.transform(ordered, lambda r: r[outcome]).alias("recent"))
        .withColumn("recent_pattern", F.concat_ws(", ", "recent"))
    )


def flip_rate(
    df: DataFrame,
    test: str = "test_name",
    time: str = "created_at",
    tie: str = "id",
    outcome: str = "outcome",
    slice_seconds: int = 3600,
) -> DataFrame:
    """Share of neighbouring outcomes that differ: (test, runs, flips, flip_rate).

    A hot test must not end up in one task. Outcomes are compared inside time slices
    of a test first; then only the first and last outcome of each slice are
    compared along the test. The sum of both is exact for every slice width. Outcomes
    without a time come first, in the order of ``tie``.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.select(
        test, time, tie, outcome, F.floor(at / F.lit(slice_seconds * 1_000_000)).alias("_slice")
    )
    inside = Window.partitionBy(test, "_slice").orderBy(time, tie)
    moment = F.struct(time, tie)
    slices = (
        rows.withColumn("_before", F.lag(outcome).over(inside))
        .groupBy(test, "_slice")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(F.col("_before") != F.col(outcome)).alias("flips"),
            F.min_by(outcome, moment).alias("_first"),
            F.max_by(outcome, moment).alias("_last"),
        )
    )
    along = Window.partitionBy(test).orderBy("_slice")
    return (
        slices.withColumn("_before", F.lag("_last").over(along))
        .withColumn("flips", F.col("flips") + (F.coalesce(F.col("_before") != F.col("_first"), F.lit(False))).cast("bigint"))
        .groupBy(test)
        .agg(F.sum("runs").alias("runs"), F.sum("flips").alias("flips"))
        .withColumn(
            "flip_rate",
            F.when(F.col("runs") > 1, F.col("flips") / (F.col("runs") - 1)).otherwise(F.lit(0.0)),
        )
    )


def explode_pattern(df: DataFrame, pattern: str = "recent_pattern") -> DataFrame:
    """One row per outcome of the pattern text, with its position (0 = oldest)."""
    return df.select("*", F.posexplode(F.split(pattern, ", ")).alias("position", "outcome"))
