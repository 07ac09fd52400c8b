"""The whole training flow: clean, cap, split, featurize, balance, fit, choose, save."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..sources.store import cut
from . import evaluate, models
from .oversample import smote
from .sampling import cap_per_class, stratified_split


class TrainingSet:
    """Feature stages and the two sides of a cleaned training table.

    All rows are split; the training side that a classifier is fitted on is kept, bounded to
    ``cap`` rows per class, or whole if ``cap`` is None. The test side and ``features`` cover every row.
    Features are fitted on that training side; ``fit_before_split`` fits them on as many rows
    of both sides.
    """

    def __init__(self, rows: DataFrame, key: str = "test_id", cap: int | None = 2000, test_share: float = 0.2,
                 fit_before_split: bool = False, message_terms: int = 500, trace_terms: int = 200):
        columns = [key, "root_cause", "error_message", "stack_trace"]
        self.rows = rows.select(*columns, *models.CATEGORY_COLUMNS, *models.NUMBER_COLUMNS)
        classes = vocab.ROOT_CAUSES
        self.key = key
        # Each side is used many times; written ones keep the plans of what follows small.
        split = cut(stratified_split(self.rows, "root_cause", key, test_share, classes=classes), "split")
        self.test_rows = split.filter("side = 'test'")
        self.train_rows = bounded(split.filter("side = 'train'"), "root_cause", key, cap, classes)
        fit_on = bounded(self.rows, "root_cause", key, cap, classes) if fit_before_split else self.train_rows
        self.stages = models.fit_features(fit_on, key, message_terms, trace_terms)
        if fit_before_split:
            fit_on.unpersist()
        prepared = models.prepare(self.stages, self.train_rows, keep=(key,))
        self.train = in_key_order(cut(models.with_class_weights(prepared), "train"), key)

    def features(self) -> DataFrame:
        """Features of all rows, also of those without a known class."""
        return self.stages.transform(self.rows).select(self.key, "features")

    def test(self) -> DataFrame:
        return models.prepare(self.stages, self.test_rows, keep=(self.key,))

    def balanced(self, threshold: int = 500, neighbors: int = 5) -> DataFrame:
        """Training rows plus the synthetic ones; no class has less than the largest,
        unless all have ``threshold`` rows already."""
        arrays = self.train.select("label", self.key, vector_to_array("features").alias("v"))
        made = smote(arrays, "label", self.key, "v", threshold, neighbors)
        new = made.select("label", array_to_vector("vector").alias("features"))
        return models.with_class_weights(cut(self.train.select("label", "features").unionByName(new), "balanced"))

    def release(self) -> None:
        self.train.unpersist()
        self.train_rows.unpersist()


def bounded(rows: DataFrame, label: str, key: str, cap: int | None = 2000, classes: list | None = None) -> DataFrame:
    """At most ``cap`` rows per class to fit on, all if it is None, kept, in an order that does not
    depend on the input's partitions: fits draw their rows by position."""
    if cap is None:
        known = rows if classes is None else rows.filter(F.col(label).isin(list(classes)))
        return in_key_order(known, key)
    return in_key_order(cut(cap_per_class(rows, label, key, cap, classes=classes), "bounded"), key)


#: Rows of a partition to fit on. Every partition of a forest's fit sends sums for all nodes of all
#: trees, so what it shuffles grows with the partitions, not with the rows.
FIT_ROWS = 4000


def in_key_order(rows: DataFrame, key: str) -> DataFrame:
    """Written rows, kept in as few partitions as their number needs, whatever the session's setting."""
    parts = max(1, -(-rows.count() // FIT_ROWS))
    if parts > models.FEW_PARTS:  # beyond, by the root of the rows, as tasks have to stay small as well
        parts = math.ceil(math.sqrt(models.FEW_PARTS * parts))
    return rows.repartition(parts, key).sortWithinPartitions(key).persist()


def report(model, test: DataFrame, name: str, classes: list[str] | None = None) -> DataFrame:
    """All metrics of a model on prepared rows."""
    names = F.array(*[F.lit(c) for c in sorted(classes or vocab.ROOT_CAUSES)])
    scored = model.transform(test).select(
        F.col("root_cause").alias("truth"), F.get(names, F.col("prediction").cast("int")).alias("guess")
    )
    # A few rows; whoever judges them several times need not score again.
    return cut(evaluate.metrics_table(scored, name, "truth", "guess"), "metrics")


@dataclass
class Trained:
    name: str
    stages: PipelineModel
    model: object
    metrics: DataFrame


def train_classifier(
    rows: DataFrame, path: str, trees: int = 50, depth: int = 10, rounds: int = 50, preferred: str = "RandomForest",
    **options,
) -> Trained:
    """Train forest and boosted trees on cleaned rows, keep the more accurate one, save it
    and its metrics below ``path``. A tie goes to ``preferred``."""
    data = TrainingSet(rows, **options)
    try:
        train = data.balanced().persist()
        fitted = {
            "RandomForest": models.train_random_forest(train, trees, depth),
            "GradientBoosting": models.train_gradient_boosting(train, rounds),
        }
        train.unpersist()
        metrics = None
        for name, model in fitted.items():
            part = report(model, data.test(), name)
            metrics = part if metrics is None else metrics.unionByName(part)
        models.write_metrics_json(metrics, f"{path}/metrics")
        saved = models.read_metrics_json(rows.sparkSession, f"{path}/metrics")
        accuracy = saved.filter("class IS NULL AND metric = 'accuracy'")
        best = evaluate.select_best(accuracy.select("model", F.col("value").alias("accuracy")), preferred).first()
        models.save_model(data.stages, fitted[best["model_name"]], f"{path}/model")
        return Trained(best["model_name"], data.stages, fitted[best["model_name"]], saved)
    finally:
        data.release()
