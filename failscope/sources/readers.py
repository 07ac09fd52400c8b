"""Readers for CSV data sets, JSON uploads and plain logs; the CSV writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import vocab
from ..functions.columns import NUMBER, UNICODE, first_filled, strip
from . import schemas
from .records import csv_records, parse_records


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    multiline: bool = True,
    missing_texts: list[str] | None = None,
    whole_files: bool = False,
) -> DataFrame:
    """CSV with header, all text, doubled quotes as escape, bad bytes as U+FFFD.

    Messages and traces hold line breaks, so cells may span lines. Large files are still read by
    many tasks, which find the records first (see ``records``); ``whole_files`` reads a file with
    such cells in one task instead, and ``multiline=False`` takes every line for a record.
    ``missing_texts`` lists cell texts to read as null.
    """
    if multiline and not whole_files:
        df = parse_records(csv_records(spark, path), schema)
    else:
        df = (
            spark.read.schema(schema)
            .option("header", True)
            .option("multiLine", multiline)
            .option("quote", '"')
            .option("escape", '"')
            .option("encoding", "UTF-8")
            .csv(path)
        )
    if missing_texts:
        df = df.select(*[F.when(~F.col(c).isin(missing_texts), F.col(c)).alias(c) for c in df.columns])
    return df


def scan_csv_runs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return scan_csv(spark, path, schemas.RUNS_CSV, multiline)


def scan_csv_training(
    spark: SparkSession, path: str, multiline: bool = True, missing: bool = True
) -> DataFrame:
    """Training CSV; by default the usual missing-value texts ("N/A", "nan", ...) are null."""
    return scan_csv(spark, path, schemas.TRAINING_CSV, multiline, vocab.CSV_MISSING if missing else None)


def sink_csv_training(df: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """Write the training fields with header; quotes are doubled.

    ``file_rows`` bounds each file, for readers that cannot split files whose cells hold line breaks.
    """
    (
        df.select(*[F.col(c).cast("string").alias(c) for c in schemas.TRAINING_FIELDS])
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", file_rows)
        .csv(path)
    )


# --- uploads ---------------------------------------------------------------------------

UPLOAD_KEYS = [
    "test_name", "testName", "error_message", "errorMessage", "message", "stack_trace",
    "stackTrace", "logs", "failure_stage", "failure_type", "severity", "retry_count",
    "pipeline", "old_locator", "old_value",
]
UPLOAD = StructType([StructField(k, StringType()) for k in UPLOAD_KEYS])


def _filled(doc, variant) -> dict:
    """Texts of the upload keys; numbers equal to zero and ``false`` count as empty.

    ``from_json`` turns every value into text; the variant still knows its type.
    """
    out = {}
    for k in UPLOAD_KEYS:
        kind = F.schema_of_variant(F.try_variant_get(variant, f"$.{k}", "variant"))
        empty = (kind != "STRING") & ((doc[k] == "false") | (doc[k].try_cast("double") == 0.0))
        out[k] = F.when(~F.coalesce(empty, F.lit(False)), doc[k])
    return out


def _json_fields(doc, name, variant) -> dict:
    raw = doc["retry_count"]
    retry = (
        F.when(raw.isNull() | (strip(raw) == ""), F.lit(0.0))
        .when(raw == "true", F.lit(1.0))
        .when(raw == "false", F.lit(0.0))
        .when(raw.rlike(NUMBER), raw.try_cast("double"))
    )
    doc = _filled(doc, variant)
    return {
        "test_name": first_filled(doc["test_name"], doc["testName"], name),
        "error_message": first_filled(doc["error_message"], doc["errorMessage"], doc["message"], default=""),
        "stack_trace": first_filled(doc["stack_trace"], doc["stackTrace"], default=""),
        "logs": first_filled(doc["logs"], default=""),
        "failure_stage": first_filled(doc["failure_stage"], default=vocab.INPUT_DEFAULTS["failure_stage"]),
        "failure_type": first_filled(doc["failure_type"], default=vocab.INPUT_DEFAULTS["failure_type"]),
        "severity": first_filled(doc["severity"], default=vocab.INPUT_DEFAULTS["severity"]),
        "retry_count": retry,
        "pipeline": first_filled(doc["pipeline"], default=vocab.UPLOAD_PIPELINE),
        "old_locator": first_filled(doc["old_locator"], doc["old_value"], default=""),
    }


def _text_fields(text, name) -> dict:
    lines = F.split(text, "\n")
    tell = F.filter(lines, lambda line: strip(line).rlike(UNICODE + r"at\s|Exception|Error"))
    has_error = text.contains("Exception") | text.contains("Error")
    d = vocab.INPUT_DEFAULTS
    return {
        "test_name": F.regexp_replace(name, r"\.(log|json|txt)$", ""),
        "error_message": first_filled(F.substring(F.get(lines, F.lit(0)), 1, 500), default=F.substring(text, 1, 500)),
        "stack_trace": F.when(has_error, F.array_join(tell, "\n")).otherwise(""),
        "logs": text,
        "failure_stage": F.lit(d["failure_stage"]),
        "failure_type": F.lit(d["failure_type"]),
        "severity": F.lit(d["severity"]),
        "retry_count": F.lit(d["retry_count"]),
        "pipeline": F.lit(vocab.UPLOAD_PIPELINE),
        "old_locator": F.lit(d["old_locator"]),
    }


def ingest_json(df: DataFrame, text: str = "text", name: str = "file_name") -> DataFrame:
    """JSON uploads to analyze input: alias names, then defaults.

    A retry count that is no number stays null, and the row is then not scored for
    flakiness.
    """
    parsed = df.withColumns({"_doc": F.from_json(text, UPLOAD), "_variant": F.try_parse_json(text)})
    fields = _json_fields(F.col("_doc"), F.col(name), F.col("_variant"))
    return parsed.withColumns(fields).drop("_doc", "_variant")


def ingest_text_log(df: DataFrame, text: str = "text", name: str = "file_name") -> DataFrame:
    """Plain logs to analyze input."""
    return df.withColumns(_text_fields(F.col(text), F.col(name)))


def route_by_format(df: DataFrame, text: str = "text", name: str = "file_name") -> DataFrame:
    """JSON uploads as JSON, everything else as plain text; one pass over the input.

    ``format`` says which way a row went.
    """
    is_json = F.try_parse_json(text).isNotNull() & (strip(text) != "null")
    parsed = df.withColumns(
        {
            "format": F.when(F.coalesce(is_json, F.lit(False)), "json").otherwise("text"),
            "_doc": F.from_json(text, UPLOAD),
            "_variant": F.try_parse_json(text),
        }
    )
    as_json = _json_fields(F.col("_doc"), F.col(name), F.col("_variant"))
    as_text = _text_fields(F.col(text), F.col(name))
    return parsed.withColumns(
        {c: F.when(F.col("format") == "json", as_json[c]).otherwise(as_text[c]) for c in as_json}
    ).drop("_doc", "_variant")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """One row per uploaded file: (file_name, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")
    )
