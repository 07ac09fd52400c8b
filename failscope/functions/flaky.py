"""Flakiness score as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .columns import col, lookup


def instability_score(retry, failure_type, stage, severity, duration) -> Column:
    """Sum of five capped terms, four decimals, at most 1.

    The terms are doubles and are added left to right, so that the last digit does
    not depend on the engine. Null retry, severity or duration gives null.
    """
    retry, duration = col(retry), col(duration)
    by_retry = F.when(retry.isNotNull(), F.least(retry / F.lit(5.0), F.lit(0.40)))
    by_type = F.when(col(failure_type).isin(vocab.FLAKY_TYPES), F.lit(0.20)).otherwise(F.lit(0.0))
    by_stage = F.when(col(stage) == "test", F.lit(0.10)).otherwise(F.lit(0.0))
    by_severity = F.when(
        col(severity).isNotNull(),
        lookup(F.upper(col(severity)), vocab.SEVERITY_WEIGHTS, vocab.SEVERITY_OTHER),
    )
    by_duration = (
        F.when(duration > 120, F.lit(0.10))
        .when(duration > 60, F.lit(0.05))
        .when(duration.isNotNull(), F.lit(0.0))
    )
    total = by_retry + by_type + by_stage + by_severity + by_duration
    return F.when(total.isNotNull(), F.least(F.round(total, 4), F.lit(1.0)))


def risk_level(score) -> Column:
    score = col(score)
    return F.when(score >= 0.65, "High").when(score >= 0.40, "Medium").otherwise("Low")


def is_flaky(score) -> Column:
    return col(score) >= 0.40
