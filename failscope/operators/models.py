"""Training and scoring with Spark ML.

Only model state reaches the driver: vocabularies (at most 5,000 terms), category
lists and trees. Rows stay distributed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer, StringIndexer,
    StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from . import boosting, features
from .parallel import FEW, few_values, per_group
from .sampling import class_weights

CATEGORY_COLUMNS = ["failure_stage", "severity", "failure_type"]
NUMBER_COLUMNS = ["retry_count", "test_duration_sec", "cpu_usage_pct", "memory_usage_mb", "is_flaky_test"]
#: Partitions of a bounded training side, at most.
FEW_PARTS = 8
STRUCTURED_TEXT = [
    "failure_stage", "error_code", "ci_tool", "language", "os", "cloud_provider", "severity",
]
STRUCTURED_NUMBERS = [
    "retry_count", "cpu_usage_pct", "memory_usage_mb", "build_duration_sec",
    "test_duration_sec", "deploy_duration_sec",
]


class SublinearTf(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Counts above zero to 1 + ln(count). Sparse vectors stay sparse: only the stored counts are
    touched, as one Arrow array per batch; arrays of whole vectors would cost every row the whole vocabulary."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        if inputCol:
            self._set(inputCol=inputCol)
        if outputCol:
            self._set(outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        def scale(vectors):
            held = vectors.field("values")
            counts = held.values.to_numpy(zero_copy_only=False)
            scaled = np.where(counts > 0, 1.0 + np.log(np.maximum(counts, 1.0)), 0.0)
            parts = {f.name: vectors.field(f.name) for f in vectors.type}
            parts["values"] = pa.ListArray.from_arrays(held.offsets, pa.array(scaled), type=held.type)
            return pa.StructArray.from_arrays(list(parts.values()), fields=list(vectors.type), mask=vectors.is_null())

        scaled = F.arrow_udf(scale, VectorUDT())
        return df.withColumn(self.getOutputCol(), scaled(F.col(self.getInputCol())))


# --- feature stages --------------------------------------------------------------------

def text_stages(
    train: DataFrame, key: str, text: str, k: int, bigrams: bool = True, sublinear: bool = True,
    stop_words: list[str] | None = None,
) -> list:
    """Fitted stages: ``text`` to the unit-length TF-IDF vector ``<text>_tfidf``."""
    tokens = features.words(text)
    if stop_words:
        tokens = features.remove_stop_words(tokens, stop_words)
    docs = train.select(key, tokens.alias("_words")).select(
        key, features.terms(F.col("_words"), bigrams).alias("terms")
    )
    stats = features.term_statistics(features.term_counts(docs, key))
    # At most k rows: the model's vocabulary, sorted as its index order.
    fitted = features.idf_table(features.vocabulary_topk(stats, k), docs).select("term", "idf").collect()
    fitted.sort(key=lambda r: r["term"])
    names, weights = [r["term"] for r in fitted], [r["idf"] for r in fitted]
    if not names:  # no text at all: one term that never occurs keeps the width positive
        names, weights = ["\u0000"], [1.0]

    raw = f"regexp_extract_all(lower(coalesce({text}, '')), '{features.WORD.replace(chr(92), chr(92) * 2)}', 0)"
    if stop_words:
        listed = ", ".join("'" + w.replace("'", "\\'") + "'" for w in stop_words)
        raw = f"filter({raw}, t -> t NOT IN ({listed}))"
    split = SQLTransformer(statement=f"SELECT *, {raw} AS {text}_words FROM __THIS__")
    pairs = (
        f"concat({text}_words, zip_with(slice({text}_words, 1, greatest(size({text}_words) - 1, 0)), "
        f"slice({text}_words, 2, greatest(size({text}_words) - 1, 0)), (a, b) -> concat_ws(' ', a, b)))"
    )
    join = SQLTransformer(
        statement=f"SELECT *, {pairs if bigrams else text + '_words'} AS {text}_terms FROM __THIS__"
    )
    count = CountVectorizerModel.from_vocabulary(names, inputCol=f"{text}_terms", outputCol=f"{text}_tf")
    stages = [split, join, count]
    tf = f"{text}_tf"
    if sublinear:
        stages.append(SublinearTf(inputCol=tf, outputCol=f"{text}_sub"))
        tf = f"{text}_sub"
    stages.append(
        ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=tf, outputCol=f"{text}_weighted")
    )
    stages.append(Normalizer(p=2.0, inputCol=f"{text}_weighted", outputCol=f"{text}_tfidf"))
    return stages


def default_stage() -> SQLTransformer:
    """``<column>_given`` per category and number, with the input default where it is null."""
    filled = [f"coalesce({c}, '{vocab.INPUT_DEFAULTS[c]}') AS {c}_given" for c in CATEGORY_COLUMNS]
    filled += [f"coalesce(cast({c} AS double), {float(vocab.INPUT_DEFAULTS[c])}D) AS {c}_given" for c in NUMBER_COLUMNS]
    return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def few_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, after a check that its indexed columns have few values: these go to the driver."""
    for c in columns:
        if few_values(df, c) is None:
            raise ValueError(f"{c} has more than {FEW} values; it is no category")
    return df


def category_stages(train: DataFrame, columns: list[str]) -> list:
    """Fitted stages: sorted category index per column, -1 for unseen values."""
    outs = [f"{c}_index" for c in columns]
    indexer = StringIndexer(
        inputCols=[f"{c}_given" for c in columns], outputCols=outs, stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(few_labels(train, [f"{c}_given" for c in columns]))
    codes = ", ".join(
        f"CASE WHEN {o} >= {len(seen)} THEN -1.0D ELSE {o} + 0.0D END AS {c}_code"
        for c, o, seen in zip(columns, outs, indexer.labelsArray)
    )
    return [indexer, SQLTransformer(statement=f"SELECT *, {codes} FROM __THIS__")]


def fit_features(
    train: DataFrame, key: str = "test_id", message_terms: int = 500, trace_terms: int = 200
) -> PipelineModel:
    """Text, category and number features in one sparse vector ``features``.

    Null texts count as empty, null categories and numbers as the input defaults.
    """
    fill = default_stage()
    stages = [fill, *text_stages(train, key, "error_message", message_terms)]
    stages += text_stages(train, key, "stack_trace", trace_terms)
    stages += category_stages(fill.transform(train), CATEGORY_COLUMNS)
    inputs = ["error_message_tfidf", "stack_trace_tfidf"]
    inputs += [f"{c}_code" for c in CATEGORY_COLUMNS] + [f"{c}_given" for c in NUMBER_COLUMNS]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return PipelineModel(stages)


def label_indexer(classes: list[str], column: str = "root_cause", into: str = "label") -> StringIndexerModel:
    """Sorted class index of a stated class list."""
    return StringIndexerModel.from_labels(
        sorted(classes), inputCol=column, outputCol=into, handleInvalid="skip"
    )


def prepare(features_model: PipelineModel, df: DataFrame, classes: list[str] | None = None,
            keep: tuple[str, ...] = ("test_id",)) -> DataFrame:
    """(keep..., label, weight-free features) of labelled rows."""
    out = label_indexer(classes or vocab.ROOT_CAUSES).transform(features_model.transform(df))
    return out.select(*keep, F.col("root_cause"), "label", "features")


def with_class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = n / (classes * count); one row per class is joined."""
    weights = per_group(class_weights(train, label).select(label, "weight"), few_values(train, label))
    return train.join(weights, label)


# --- training --------------------------------------------------------------------------

def _forest(trees: int, depth: int, seed: int, memory: int = 1024) -> RandomForestClassifier:
    """Node ids are cached per row, and more nodes fit into one pass: deep trees need both."""
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed,
        cacheNodeIds=True, maxMemoryInMB=memory,
    )


def pass_memory(train: DataFrame) -> int:
    """MB of sums that a task holds in one pass. Many rows grow as many nodes as fit, in every task at
    once; where rows lie in many partitions, tasks keep to Spark's own bound."""
    return 1024 if train.rdd.getNumPartitions() <= FEW_PARTS else 256


def train_random_forest(
    train: DataFrame, trees: int = 50, depth: int = 10, seed: int = 42, balanced: bool = True
):
    """Random forest; Spark trees end at depth 30 at the latest."""
    rf = _forest(trees, depth, seed, pass_memory(train))
    if balanced:
        rf = rf.setWeightCol("weight")
        if "weight" not in train.columns:
            train = with_class_weights(train)
    return rf.fit(train)


def train_gradient_boosting(
    train: DataFrame, rounds: int = 50, depth: int = 3, rate: float = 0.1, classes: int | None = None
) -> boosting.BoostedClasses:
    """Boosted trees of all classes together: softmax residuals, one tree per class and round."""
    return boosting.fit(train, rounds, depth, rate, classes)


def train_text_baseline(
    train: DataFrame, key: str, text: str = "error_message", label: str = "failure_type",
    k: int = 5000, iterations: int = 1000,
) -> PipelineModel:
    """TF-IDF over words without stop words, then logistic regression."""
    stop = features.english_stop_words(train.sparkSession)
    stages = text_stages(train, key, text, k, bigrams=False, sublinear=False, stop_words=stop)
    labels = StringIndexer(
        inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(few_labels(train, [label]))
    lr = LogisticRegression(
        featuresCol=f"{text}_tfidf", labelCol="label", maxIter=iterations,
        # Same penalty as an inverse strength of 1 summed over all rows.
        regParam=1.0 / max(train.count(), 1), standardization=False,
    )
    data = PipelineModel(stages + [labels]).transform(train).select("label", f"{text}_tfidf")
    return PipelineModel(stages + [labels, lr.fit(data)])


def train_structured_baseline(
    train: DataFrame, label: str = "failure_type", trees: int = 100, depth: int = 30, seed: int = 42
) -> PipelineModel:
    """Label-encoded columns as plain numbers, then a random forest.

    A cell that is no number counts as zero, so that every row gets a prediction.
    """
    text, numbers = STRUCTURED_TEXT, STRUCTURED_NUMBERS
    indexer = StringIndexer(
        inputCols=text, outputCols=[f"{c}_index" for c in text], stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )
    # Adding zero drops the category metadata: the codes are used as numbers.
    plain = ", ".join([f"{c}_index + 0.0D AS {c}_code" for c in text]
                      + [f"coalesce(try_cast({c} AS double), 0.0D) AS {c}_num" for c in numbers])
    cast = SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__")
    assemble = VectorAssembler(
        inputCols=[f"{c}_code" for c in text] + [f"{c}_num" for c in numbers],
        outputCol="features", handleInvalid="keep",
    )
    labels = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep")
    rf = _forest(trees, depth, seed)
    return Pipeline(stages=[indexer, cast, assemble, labels, rf]).fit(few_labels(train, [*text, label]))


def tune_grid(train: DataFrame, trees=(50, 100), depths=(10, 20), folds: int = 3, parallelism: int = 4):
    """Cross-validated search over forest size and depth; returns the fitted validator."""
    rf = _forest(20, 5, 42, pass_memory(train))
    grid = ParamGridBuilder().addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, list(depths)).build()
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    return CrossValidator(
        estimator=rf, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=42,
        parallelism=parallelism,
    ).fit(train)


# --- scoring ---------------------------------------------------------------------------

def class_probabilities(model, df: DataFrame) -> DataFrame:
    """Add ``probabilities`` (array in class order) for a forest or a boosted model."""
    return model.transform(df).withColumn("probabilities", vector_to_array("probability"))


def _decide(df: DataFrame, classes: list[str], model_name: str) -> DataFrame:
    """probabilities -> root_cause, confidence, all_probabilities, model_used."""
    names = F.array(*[F.lit(c) for c in sorted(classes)])
    best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    return df.withColumns(
        {
            "root_cause": F.get(names, best - 1),
            "confidence": F.round(F.array_max("probabilities"), 4),
            "all_probabilities": F.map_from_arrays(
                names, F.transform("probabilities", lambda p: F.round(p, 4))
            ),
            "model_used": F.lit(model_name),
        }
    ).drop("probabilities")


def score_failures(
    df: DataFrame, features_model: PipelineModel, model, model_name: str = "RandomForest",
    classes: list[str] | None = None,
) -> DataFrame:
    """Add predicted cause, confidence, all probabilities and model name to every row.

    A given ``root_cause`` column is replaced.
    """
    columns = [c for c in df.columns if c != "root_cause"]
    scored = class_probabilities(model, features_model.transform(df))
    decided = _decide(scored.drop("root_cause"), classes or vocab.ROOT_CAUSES, model_name)
    return decided.select(
        *[c for c in columns if c not in ("confidence", "all_probabilities", "model_used")],
        "root_cause", "confidence", "all_probabilities", "model_used",
    )


def vote_ensemble(
    df: DataFrame, features_model: PipelineModel, models: list, classes: list[str] | None = None
) -> DataFrame:
    """Soft vote: the mean of the models' class probabilities decides."""
    columns = [c for c in df.columns if c not in ("root_cause", "confidence", "all_probabilities", "model_used")]
    scored = features_model.transform(df).drop("root_cause")
    for i, model in enumerate(models):
        scored = (
            class_probabilities(model, scored)
            .withColumnRenamed("probabilities", f"_p{i}")
            .drop("rawPrediction", "probability", "prediction")
        )
    mean = F.col("_p0")
    for i in range(1, len(models)):
        mean = F.zip_with(mean, F.col(f"_p{i}"), lambda a, b: a + b)
    scored = scored.withColumn("probabilities", F.transform(mean, lambda p: p / F.lit(float(len(models)))))
    decided = _decide(scored, classes or vocab.ROOT_CAUSES, "Ensemble")
    return decided.select(*columns, "root_cause", "confidence", "all_probabilities", "model_used")


# --- persistence -----------------------------------------------------------------------

def save_model(features_model: PipelineModel, model, path: str) -> None:
    features_model.write().overwrite().save(f"{path}/features")
    PipelineModel([model]).write().overwrite().save(f"{path}/classifier")


def load_model(path: str):
    """(feature stages, classifier) as saved."""
    return PipelineModel.load(f"{path}/features"), PipelineModel.load(f"{path}/classifier").stages[0]


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """Metrics (model, class, metric, value) as one JSON document, one line per model.

    The table has a few rows per class.
    """
    scalars = F.map_from_entries(
        F.collect_list(F.when(F.col("class").isNull(), F.struct("metric", "value")))
    )
    per_class = F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "metric", "value")))
    doc = metrics.groupBy("model").agg(scalars.alias("overall"), per_class.alias("per_class"))
    doc.coalesce(1).write.mode("overwrite").json(path)


def read_metrics_json(spark, path: str) -> DataFrame:
    """Back to the long form."""
    schema = (
        "model string, overall map<string, double>, "
        "per_class array<struct<class: string, metric: string, value: double>>"
    )
    docs = spark.read.schema(schema).json(path)
    overall = docs.select(
        "model", F.lit(None).cast("string").alias("class"), F.explode("overall").alias("metric", "value")
    )
    classes = docs.select("model", F.inline("per_class"))
    return overall.unionByName(classes)
