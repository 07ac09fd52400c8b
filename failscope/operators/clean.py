"""Input defaults and training-set cleaning. All operators are projections or filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import draw_below, draw_int, flag_or_zero, first_filled, lookup, number_or, strip


def apply_input_defaults(df: DataFrame) -> DataFrame:
    """Fill missing optional inputs; columns the table lacks are added."""
    fills = {}
    for name, default in vocab.INPUT_DEFAULTS.items():
        value = F.lit(default)
        fills[name] = F.coalesce(F.col(name), value) if name in df.columns else value
    return df.withColumns(fills)


def require_fields(df: DataFrame, fields: tuple[str, ...] = ("test_name", "error_message")) -> DataFrame:
    """Add ``reject_reason``: the first required field that is empty, else null."""
    reason = None
    for f in fields:
        empty = F.coalesce(F.col(f), F.lit("")) == ""
        text = f"{f} is required"
        reason = F.when(empty, text) if reason is None else reason.when(empty, text)
    return df.withColumn("reject_reason", reason)


def split_rejected(df: DataFrame, fields: tuple[str, ...] = ("test_name", "error_message")):
    """(good rows, quarantined rows with their reason)."""
    checked = require_fields(df, fields)
    good = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, checked.filter(F.col("reject_reason").isNotNull())


def drop_null_target(df: DataFrame, target: str = "root_cause") -> DataFrame:
    return df.na.drop(subset=[target])


def normalize_label(df: DataFrame, label: str = "root_cause") -> DataFrame:
    return df.withColumn(label, F.lower(strip(label)))


def valid_class_filter(df: DataFrame, label: str = "root_cause", classes=None) -> DataFrame:
    return df.filter(F.col(label).isin(list(classes or vocab.ROOT_CAUSES)))


def null_fill_text(df: DataFrame, fills: dict[str, str] | None = None) -> DataFrame:
    return df.fillna(fills or vocab.TEXT_FILLS)


def numeric_coerce(df: DataFrame, fills: dict[str, float] | None = None) -> DataFrame:
    """Text columns to doubles; what is no number gets the column's default."""
    fills = fills or vocab.NUMBER_FILLS
    return df.withColumns({c: number_or(c, d) for c, d in fills.items()})


def bool_coerce(df: DataFrame, flag: str = "is_flaky_test", digits: bool = False) -> DataFrame:
    """Flag column (boolean or text) to 0 / 1."""
    if dict(df.dtypes)[flag] == "boolean":
        return df.withColumn(flag, F.coalesce(F.col(flag).cast("int"), F.lit(0)))
    return df.withColumn(flag, flag_or_zero(flag, digits))


def project_dropna(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).na.drop("any")


def clean_training(df: DataFrame) -> DataFrame:
    """All cleaning steps of the training set, in order; one stage."""
    df = valid_class_filter(normalize_label(drop_null_target(df)))
    return bool_coerce(numeric_coerce(null_fill_text(df)))


# --- training set preparation --------------------------------------------------------

def category_map(failure_type: str | Column) -> Column:
    """Root cause of a CI failure type."""
    c = F.col(failure_type) if isinstance(failure_type, str) else failure_type
    return lookup(c, vocab.CATEGORY_CAUSES, vocab.CATEGORY_OTHER)


def remap_runs_schema(runs: DataFrame) -> DataFrame:
    """Raw CI rows (all text) to the training fields (all text)."""

    def text(name, default=""):
        return F.coalesce(F.col(name), F.lit(default)) if name in runs.columns else F.lit(default)

    kind = text("failure_type")
    renamed = {
        "test_id": text("run_id"),
        "test_name": F.concat(kind, F.lit(" — "), text("repository")),
        "pipeline": text("ci_tool"),
        "browser": F.lit("N/A"),
        "root_cause": category_map(kind),
        "failure_type": kind,
        "stack_trace": F.lit(""),
        "old_value": F.lit("N/A"),
        "new_value": F.lit("N/A"),
        "retry_count": text("retry_count", "0"),
        "test_duration_sec": text("test_duration_sec", "0"),
        "cpu_usage_pct": text("cpu_usage_pct", "0"),
        "memory_usage_mb": text("memory_usage_mb", "0"),
        "is_flaky_test": text("is_flaky_test", "False"),
        "recommendation": F.lit(""),
        "developer_alert": text("incident_created", "False"),
    }
    return runs.select(*[renamed.get(f, text(f)).alias(f) for f in vocab.TRAINING_FIELDS])


def generic_message_noise(
    df: DataFrame, key: str = "test_id", share: float = 0.15, seed: str = "generic"
) -> DataFrame:
    """Replace message and trace of a fixed share of the rows by uninformative ones."""
    hit = draw_below(seed, key, share)
    texts = F.array(*[F.lit(m) for m in vocab.GENERIC_MESSAGES])
    pick = F.get(texts, (draw_int(seed, key) % len(vocab.GENERIC_MESSAGES)).cast("int"))
    return df.withColumns(
        {
            "error_message": F.when(hit, pick).otherwise(F.col("error_message")),
            "stack_trace": F.when(hit, vocab.GENERIC_TRACE).otherwise(F.col("stack_trace")),
        }
    )


def label_noise(
    df: DataFrame,
    key: str = "test_id",
    label: str = "root_cause",
    share: float = 0.10,
    seed: str = "label",
    classes: list[str] | None = None,
) -> DataFrame:
    """Replace the label of a fixed share of the rows by one of the other classes."""
    classes = sorted(classes or vocab.ROOT_CAUSES)
    others = F.array_except(F.array(*[F.lit(c) for c in classes]), F.array(F.col(label)))
    pick = F.get(others, (draw_int(seed, key) % F.size(others)).cast("int"))
    return df.withColumn(label, F.when(draw_below(seed, key, share), pick).otherwise(F.col(label)))


def merge_datasets(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)
