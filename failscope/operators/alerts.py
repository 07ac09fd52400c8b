"""Alerts: which failures to report, to whom, with which text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import col, lookup, make_id, percent_text


def alert_filter(df: DataFrame, alert: str = "healing.developer_alert") -> DataFrame:
    return df.filter(F.col(alert))


def alert_message(test_name, root_cause, confidence, recommendation) -> Column:
    return F.concat(
        F.lit("Test '"), col(test_name),
        F.lit("' failed with root cause '"), col(root_cause),
        F.lit("' (confidence: "), percent_text(confidence),
        F.lit("). "), F.coalesce(col(recommendation), F.lit("")),
    )


def route_target(root_cause, requested=None) -> Column:
    """A known requested target wins; else the cause decides; else the developer."""
    by_cause = lookup(F.lower(col(root_cause)), vocab.CAUSE_TARGETS, "developer")
    by_cause = F.coalesce(by_cause, F.lit("developer"))
    if requested is None:
        return by_cause
    requested = col(requested)
    return F.when(requested.isin(list(vocab.TARGET_LABELS)), requested).otherwise(by_cause)


def target_label(target) -> Column:
    return lookup(col(target), vocab.TARGET_LABELS, "Developer")


def notify(df: DataFrame, target: str = "developer", into: str = "notification") -> DataFrame:
    """Add the struct column ``into``; null where the repair raises no alert.

    ``target="developer"`` sends everything to the developers; ``target="auto"``
    routes by cause.
    """
    chosen = route_target("root_cause", None if target == "auto" else F.lit(target))
    note = F.struct(
        make_id("N", "test_id").alias("notification_id"),
        alert_message("test_name", "root_cause", "confidence", "healing.recommendation").alias("message"),
        chosen.alias("target"),
        F.lit("sent").alias("status"),
    )
    return df.withColumn(into, F.when(F.col("healing.developer_alert"), note))


def notifications_by_target(df: DataFrame) -> DataFrame:
    """Counts per target and cause."""
    return df.groupBy("target", "root_cause").agg(F.count(F.lit(1)).alias("alerts"))
