"""The whole analysis of a failure table: four struct columns per row, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import make_id
from ..sources.readers import route_by_format
from . import models
from .alerts import notify
from .clean import apply_input_defaults, split_rejected
from .flaky import check_flaky
from .heal import heal


def triage(df: DataFrame, target: str = "developer") -> DataFrame:
    """Analyze labelled failures (``root_cause`` and ``confidence`` are given).

    Input fields that are missing get their defaults. With a fitted model, score the
    rows first (``models.score_failures``) and pass the result in.
    """
    ready = apply_input_defaults(df)
    extras = [c for c in ("all_probabilities", "model_used") if c in ready.columns]
    classified = ready.withColumn("classification", F.struct("root_cause", "confidence", *extras))
    return notify(check_flaky(heal(classified)), target)


def analyze(
    uploads: DataFrame, features_model, model, target: str = "developer", text: str = "text", name: str = "file_name"
) -> tuple[DataFrame, DataFrame]:
    """Uploaded files to (analyzed failures, quarantined files with their reason).

    Files are read as JSON or plain text, checked for the required fields, named by a hash of
    file name and content (so a repeated upload keeps its id), scored and analyzed.
    """
    good, bad = split_rejected(route_by_format(uploads, text, name))
    content = F.concat_ws("\n", F.col(name), F.col(text))
    ready = apply_input_defaults(good.withColumn("_content", content).withColumn("test_id", make_id("TEST", "_content")).drop("_content"))
    return triage(models.score_failures(ready, features_model, model), target), bad
