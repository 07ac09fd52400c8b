"""Model evaluation. Everything is a sum over one (label, prediction) count table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )


def confusion_matrix(
    df: DataFrame, classes: list[str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Counts for every pair of classes, zeros included."""
    names = F.array(*[F.lit(c) for c in classes])
    spine = df.sparkSession.range(1).select(F.explode(names).alias("label")).select(
        "label", F.explode(names).alias("prediction")
    )
    counts = confusion_counts(df, label, prediction)
    return spine.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("count", F.lit(0)).alias("count")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.round(F.avg(hit), 4).alias("accuracy"))


def _class_table(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Exact precision, recall and F1 per class."""
    counts = confusion_counts(df, label, prediction)
    hit = F.col("label") == F.col("prediction")
    one_side = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("count").alias("support"),
                         F.lit(0).cast("bigint").alias("predicted"),
                         F.when(hit, F.col("count")).otherwise(0).cast("bigint").alias("hits")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"),
                         F.col("count").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
            )
        ).alias("r")
    ).select("r.*")
    sums = one_side.groupBy("class").agg(
        F.sum("hits").alias("hits"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support")
    )
    return (
        sums.withColumn("precision", _ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn(
            "f1", _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
        )
    )


def per_class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _class_table(df, label, prediction).select(
        "class", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def macro_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _class_table(df, label, prediction).agg(
        *[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    )


def weighted_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _class_table(df, label, prediction).agg(
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1")
    )


def model_comparison(scored: dict[str, DataFrame], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy per model."""
    parts = [
        accuracy(df, label, prediction).select(F.lit(name).alias("model"), "accuracy")
        for name, df in scored.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def select_best(comparison: DataFrame, preferred: str = "RandomForest") -> DataFrame:
    """Model with the highest accuracy; a tie goes to ``preferred``."""
    order = F.struct(F.col("accuracy"), (F.col("model") == preferred).cast("int"))
    return comparison.agg(
        F.max_by("model", order).alias("model_name"), F.max("accuracy").alias("accuracy")
    )


def metrics_table(df: DataFrame, model_name: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Long form of all metrics: (model, class, metric, value); class is null for the
    overall ones. A rollup gives class rows and the overall row from one pass."""
    rolled = (
        _class_table(df, label, prediction)
        .rollup("class")
        .agg(
            F.grouping("class").alias("_all"),
            *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
            F.sum("support").alias("support"),
            F.sum("hits").alias("hits"),
            F.sum(F.col("f1") * F.col("support")).alias("weighted"),
        )
    )

    def entries(**values):
        return F.array(
            *[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()]
        )

    overall = entries(
        accuracy=F.col("hits") / F.col("support"), macro_precision=F.col("precision"),
        macro_recall=F.col("recall"), macro_f1=F.col("f1"), weighted_f1=F.col("weighted") / F.col("support"),
    )
    by_class = entries(**{c: F.col(c) for c in ("precision", "recall", "f1", "support")})
    return (
        rolled.select("class", F.inline(F.when(F.col("_all") == 1, overall).otherwise(by_class)))
        .select(F.lit(model_name).alias("model"), "class", "metric", F.round("value", 4).alias("value"))
    )
