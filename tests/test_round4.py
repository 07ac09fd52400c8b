"""Neighbours without a row per query and cell, and fits on every training row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from failscope.operators import oversample


def nearest_by_hand(keys, labels, points, k):
    want = {}
    for i, key in enumerate(keys):
        d = sorted((float(np.sqrt(((points[i] - points[j]) ** 2).sum())), keys[j]) for j in range(len(keys)) if keys[j] != key and labels[j] == labels[i])
        want[key] = [(n, round(x, 9)) for x, n in d[:k]]
    return want


def found(df, **options):
    got = {}
    for r in oversample.knn_within_class(df, "g", "k", "v", 4, **options).collect():
        got.setdefault(r["k"], []).append((r["rank"], r["neighbor"], round(r["distance"], 9)))
    return {key: [x[1:] for x in sorted(rows)] for key, rows in got.items()}


@pytest.mark.parametrize("open_,block,chunk", [(0.5, 2000, 64_000_000), (0.0, 2000, 3_000), (2.0, 2000, 3_000), (2.0, 3, 64_000_000)])
def test_neighbours_write_no_row_per_cell(spark, monkeypatch, open_, block, chunk):
    """Rows whose cells part nothing, scanned at once, by few candidates at a time, by open cells, and out of crowded cells."""
    monkeypatch.setattr(oversample, "MOST_OPEN", open_)
    monkeypatch.setattr(oversample, "CHUNK_BYTES", chunk)
    written = {}
    plain = oversample.cut
    monkeypatch.setattr(oversample, "cut", lambda df, name: written.setdefault(name, []).append(out := plain(df, name)) or out)
    rng = np.random.default_rng(11)
    points = rng.normal(size=(400, 12)).astype(np.float32)
    points[390:] = points[0]
    keys, labels = [f"t{i:03d}" for i in range(400)], [i % 2 for i in range(400)]
    df = spark.createDataFrame([(k, g, p.tolist()) for k, g, p in zip(keys, labels, points)], "k string, g int, v array<float>").repartition(3)
    assert found(df, block_rows=block, cell_rows=20) == nearest_by_hand(keys, labels, points.astype(float), 4)
    assert "scanned" in written
    assert sum(df.count() for df in written.get("visits", [])) <= 400 * oversample.FEW_VISITS


@pytest.fixture(scope="module")
def many_failures(spark, tmp_path_factory):
    """More failures of each class than a bounded fit takes."""
    path = str(tmp_path_factory.mktemp("many"))
    spark.range(18_000).select(
        F.col("id").alias("event_id"), F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 60)").cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 97).alias("user_id"), F.element_at(F.array(*map(F.lit, ["error", "view", "click"])), (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 1000 / 7).alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 50, F.lit("}")).alias("props"),
    ).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["train_random_forest", "tune_grid"])
def test_models_learn_from_every_training_row(spark, monkeypatch, many_failures, name):
    from failscope.functions import vocab
    from failscope.operators import models
    from failscope.plans.queries import QUERIES
    from failscope.plans.views import view

    class Seen(Exception):
        pass

    def fit(train, *args, **options):
        raise Seen(dict(train.groupBy("label").count().collect()))

    monkeypatch.setattr(models, name, fit)
    with pytest.raises(Seen) as seen:
        QUERIES[name](spark, many_failures)
    sizes = dict(view(spark, many_failures, "failures_src").groupBy("root_cause").count().collect())
    want = {float(i): sizes[c] - int(sizes[c] * 0.2 + 0.5) for i, c in enumerate(sorted(vocab.ROOT_CAUSES))}
    assert seen.value.args[0] == want and min(want.values()) > 1000 and max(want.values()) > 2000


def test_partitions_to_fit_on_grow_slower_than_rows(spark):
    from failscope.operators import training

    few, many = (training.in_key_order(spark.range(n).withColumnRenamed("id", "k"), "k") for n in (32_000, 800_000))
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (8, 40)
    assert many.count() == 800_000
    few.unpersist(), many.unpersist()
