"""Schemas of the inputs and of the four stored tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField,
    StructType, TimestampType,
)

from ..functions.vocab import TRAINING_FIELDS


def _text(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


RUN_FIELDS = [
    "run_id", "repository", "ci_tool", "os", "language", "cloud_provider", "branch",
    "failure_stage", "failure_type", "error_code", "error_message", "severity",
    "retry_count", "cpu_usage_pct", "memory_usage_mb", "build_duration_sec",
    "test_duration_sec", "deploy_duration_sec", "is_flaky_test", "incident_created",
    "timestamp",
]

# CSV cells are read as text and cast where a column is used.
RUNS_CSV = StructType(_text(*RUN_FIELDS))
TRAINING_CSV = StructType(_text(*TRAINING_FIELDS))

ANALYZE_INPUT = StructType(
    _text("test_name", "pipeline", "error_message", "stack_trace", "logs", "failure_stage",
          "failure_type", "severity")
    + [
        StructField("retry_count", DoubleType()),
        StructField("test_duration_sec", DoubleType()),
        StructField("cpu_usage_pct", DoubleType()),
        StructField("memory_usage_mb", DoubleType()),
        StructField("is_flaky_test", IntegerType()),
        StructField("old_locator", StringType()),
    ]
)

FAILURES = StructType(
    [StructField("id", LongType(), False)]
    + [StructField(n, StringType(), False) for n in ("test_id", "test_name", "pipeline", "status", "root_cause")]
    + _text("confidence", "healing", "logs", "stack_trace", "recommendation")
    + [StructField("developer_alert", BooleanType()), StructField("created_at", TimestampType())]
)
HEALING_ACTIONS = StructType(
    [StructField("id", LongType(), False)]
    + [
        StructField(n, StringType(), False)
        for n in ("healing_id", "failure_test_id", "test_name", "repair_type", "old_value", "new_value", "status")
    ]
)
# score and pattern are kept in their own types next to the display texts.
FLAKY_TESTS = StructType(
    [StructField("id", LongType(), False)]
    + [
        StructField(n, StringType(), False)
        for n in ("test_code", "test_name", "instability_score", "recent_pattern", "risk_level")
    ]
    + [StructField("score", DoubleType()), StructField("pattern", ArrayType(StringType()))]
)
NOTIFICATIONS = StructType(
    [StructField("id", LongType(), False)]
    + [
        StructField(n, StringType(), False)
        for n in ("failure_test_id", "test_name", "root_cause", "message", "target")
    ]
)

TABLES = {
    "failures": FAILURES,
    "healing_actions": HEALING_ACTIONS,
    "flaky_tests": FLAKY_TESTS,
    "notifications": NOTIFICATIONS,
}
UNIQUE_KEYS = {
    "failures": "test_id",
    "healing_actions": "healing_id",
    "flaky_tests": "test_code",
}
# Column that ties a row of the table to its failure.
FAILURE_KEYS = {
    "failures": "test_id",
    "healing_actions": "failure_test_id",
    "flaky_tests": "test_code",
    "notifications": "failure_test_id",
}

# Columns that change records may set.
CHANGEABLE = {"failures": ("status", "healing"), "healing_actions": ("status",)}
