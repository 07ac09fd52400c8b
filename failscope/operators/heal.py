"""Repair suggestion per failure: one projection, no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import repair
from ..functions.columns import make_id


def heal(
    df: DataFrame,
    key: str = "test_id",
    message: str = "error_message",
    old_value: str = "old_locator",
    id_digits: int = 32,
    into: str = "healing",
) -> DataFrame:
    """Add the struct column ``into`` with the repair suggestion of every row.

    Rows that lack an input the rule needs get the error row (``H-ERROR``), as one
    bad record must not fail the job.
    """
    gap = repair.missing_input("root_cause", message, old_value)
    cause, play = F.col("_cause"), F.col("_play")
    locator = repair.extract_locator(message, old_value)
    wait = repair.extract_wait_call(message, old_value)

    old = (
        F.when(cause == "locator_issue", locator)
        .when(cause == "synchronization_issue", wait)
        .otherwise(repair.fallback_old_value(cause, old_value))
    )
    new = (
        F.when(cause == "locator_issue", repair.normalize_locator(F.col("_old")))
        .when(cause == "synchronization_issue", repair.upgrade_wait(F.col("_old")))
        .otherwise(play["new_value"])
    )
    error = F.struct(
        F.lit("H-ERROR").alias("healing_id"),
        F.lit("N/A").alias("repair_type"),
        F.lit("").alias("old_value"),
        F.lit("").alias("new_value"),
        F.concat(F.lit("Healing engine error: missing "), F.col("_gap")).alias("recommendation"),
        F.lit("Pending").alias("status"),
        F.lit(False).alias("developer_alert"),
    )
    advice = F.struct(
        make_id("H", key, id_digits).alias("healing_id"),
        play["repair_type"].alias("repair_type"),
        F.col("_old").alias("old_value"),
        new.alias("new_value"),
        play["recommendation"].alias("recommendation"),
        play["status"].alias("status"),
        play["developer_alert"].alias("developer_alert"),
    )
    return (
        df.withColumns({"_gap": gap, "_cause": repair.playbook_cause("root_cause")})
        .withColumns({"_play": repair.playbook_row(cause), "_old": old})
        .withColumn(into, F.when(F.col("_gap").isNotNull(), error).otherwise(advice))
        .drop("_gap", "_cause", "_play", "_old")
    )
