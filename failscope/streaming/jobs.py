"""Structured Streaming jobs over folders of JSON files.

Every job takes the source folder, a checkpoint folder and an output folder, so it can
be stopped, lost and started again; nothing is kept outside checkpoint and output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.triage import triage
from ..sources.store import persist_fanout

HELD_ROWS = 50_000
IDLE_MS = 30 * 24 * 3600 * 1000


def failure_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """JSON files as a stream; ``files_per_batch`` bounds the size of a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def stream_triage(
    stream: DataFrame, root: str, checkpoint: str, target: str = "developer",
    score: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Analyze each micro-batch and write the four tables.

    ``score`` adds cause and confidence to a batch, as ``models.score_failures`` does;
    without it the stream must carry them.

    The batch id names the output folder, so a batch that is replayed after a loss
    replaces its own files.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        persist_fanout(triage(score(batch) if score else batch, target), root, f"{batch_id:012d}")

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_dedupe(
    stream: DataFrame, out: str, checkpoint: str, key: str = "test_id", time: str = "created_at",
    delay: str = "1 hour",
) -> StreamingQuery:
    """First row per key; a repetition within ``delay`` of it is dropped."""
    unique = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return (
        unique.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_trend(
    stream: DataFrame, out: str, checkpoint: str, time: str = "created_at", delay: str = "1 hour",
    window: str = "1 day",
) -> StreamingQuery:
    """Failures per day. A day is written once, when the watermark has passed its end."""
    counts = (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .select(F.col("w.start").alias("day"), "failures")
    )
    return (
        counts.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


PATTERN_ROW = "test_name string, created_at timestamp, time_us bigint, id bigint, outcome string"
PATTERN_STATE = "time_us bigint, id bigint, outcome string"
PATTERN_OUT = "test_name string, times array<bigint>, ids array<bigint>, outcomes array<string>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _newest_of_task(last: int):
    """A task's newest ``last`` rows per test; at most ``HELD_ROWS`` and a batch are held at once."""

    def newest(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["time_us", "id"]).groupby("test_name", dropna=False, sort=False).tail(last)

    def reduce(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for chunk in chunks:
            own = newest(chunk)
            held = own if held is None else newest(pd.concat([held, own]))
            if len(held) >= HELD_ROWS:
                yield held
                held = None
        if held is not None:
            yield held

    return reduce


class LastOutcomes(StatefulProcessor):
    """The newest ``last`` outcomes of a test, as list state.

    One event-time timer per test looks at its state when the oldest promise runs out: a test
    that has run since then gets a new timer, one that has not loses its state.
    """

    def __init__(self, last: int, idle_ms: int | None) -> None:
        self.last, self.idle_ms = last, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", PATTERN_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        kept = known
        for chunk in rows:
            own = zip(chunk["time_us"].tolist(), chunk["id"].tolist(), chunk["outcome"].tolist())
            kept = sorted({*kept, *own}, key=lambda r: r[:2])[-self.last :]
        if kept == known:
            return
        self.kept.put(kept)
        if self.idle_ms and not known:
            self.handle.registerTimer(max(kept[-1][0] // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        times, ids, outcomes = ([r[i] for r in kept] for i in range(3))
        yield pd.DataFrame({"test_name": [key[0]], "times": [times], "ids": [ids], "outcomes": [outcomes]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(r[0] for r in self.kept.get()) // 1000 + self.idle_ms
        if until > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(until)
        else:
            self.kept.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_recent_pattern(
    stream: DataFrame, out: str, checkpoint: str, last: int = 5, idle_ms: int | None = IDLE_MS, delay: str = "1 day",
) -> StreamingQuery:
    """Keep the last outcomes per test as list state in RocksDB.

    Each task first reduces its rows to the newest ``last`` per test, so a hot test sends a
    few rows per task and needs no salts. Updates are written under their batch id, so
    replays replace their own files. ``idle_ms`` drops the state of tests that have not run
    for so long in event time (a month; None keeps them for ever); rows that come more than
    ``delay`` late are left out then. ``compact_recent_pattern`` keeps the newest update per
    test. Rows without a time or an id take no part.
    """
    rows = stream.withColumn("created_at", F.col("created_at").cast("timestamp")).select(
        F.col("test_name").cast("string").alias("test_name"), "created_at", F.unix_micros("created_at").alias("time_us"),
        F.col("id").cast("bigint").alias("id"), F.col("outcome").cast("string").alias("outcome"),
    )
    few = rows.filter("time_us IS NOT NULL AND id IS NOT NULL").mapInPandas(_newest_of_task(last), PATTERN_ROW)
    if idle_ms:
        few = few.withWatermark("created_at", delay)
    updates = few.groupBy("test_name").transformWithStateInPandas(
        LastOutcomes(last, idle_ms), PATTERN_OUT, "Update", "EventTime" if idle_ms else "None"
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    with using(stream.sparkSession, PROVIDER, ROCKSDB):  # a query keeps the settings it starts with
        return (
            updates.writeStream.foreachBatch(save)
            .option("checkpointLocation", checkpoint)
            .outputMode("update")
            .trigger(availableNow=True)
            .start()
        )


@contextmanager
def using(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def compact_recent_pattern(spark: SparkSession, out: str, into: str) -> None:
    """The newest update of every state as one batch in a new folder, for a new reader."""
    updates = spark.read.schema(PATTERN_OUT + ", batch string").parquet(out)
    newest = updates.groupBy("test_name").agg(F.max_by(F.struct("times", "ids", "outcomes"), "batch").alias("s"))
    last = updates.agg(F.max("batch")).first()[0] or f"{0:012d}"
    newest.select("test_name", "s.*").write.mode("overwrite").parquet(f"{into}/batch={last}")


def read_recent_pattern(spark: SparkSession, out: str, last: int = 5) -> DataFrame:
    """(test_name, recent_pattern) from the newest update of every state."""
    updates = spark.read.schema(PATTERN_OUT + ", batch string").parquet(out)
    newest = updates.groupBy("test_name").agg(
        F.max_by(F.struct("times", "ids", "outcomes"), "batch").alias("s")
    )
    rows = newest.select(
        "test_name", F.explode(F.arrays_zip("s.times", "s.ids", "s.outcomes")).alias("r")
    ).select("test_name", "r.times", "r.ids", "r.outcomes")
    rank = F.row_number().over(Window.partitionBy("test_name").orderBy(F.desc("times"), F.desc("ids")))
    kept = rows.withColumn("_rank", rank).filter(F.col("_rank") <= last)
    ordered = F.array_sort(F.collect_list(F.struct("times", "ids", "outcomes")))
    return kept.groupBy("test_name").agg(
        F.concat_ws(", ", F.transform(ordered, lambda r: r["outcomes"])).alias("recent_pattern")
    )
