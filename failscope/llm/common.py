"""Helpers that several corpus operators share."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see.

    It lies in the folder of ``spark.checkpoint.dir``; a session without that setting
    gets one below its warehouse, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{root.rstrip('/')}/corpus-{name}-{uuid.uuid4().hex[:16]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What follows can use it several times without computing it again, and a lost
    executor costs no more than the tasks that read its part.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def any_case(name: str, columns: list[str]) -> list[str]:
    """Columns that Spark, which ignores case, takes for ``name``."""
    return [c for c in columns if c.lower() == name.lower()]


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names an operator needs for its own results."""
    return df.drop(*[c for n in names for c in any_case(n, df.columns)])


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else, unlike ``lower``, which changes all letters.

    On pure ASCII both agree, and ``lower`` is much faster there.
    """
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most ``rows`` rows; reads no more than it needs to know."""
    return df.limit(rows + 1).count() <= rows


#: Rows and bytes of an Arrow batch; texts have up to tens of thousands of words.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4_000_000}


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch be larger than ``ARROW_BATCH``, in the JVM or in a worker.

    A setting of the session, as plans read it when they run; a smaller one stays.
    """
    for key, most in ARROW_BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not 0 < int(now.lower().removesuffix("b")) <= most:
            spark.conf.set(key, most)


def slices(batches, rows: int):
    """Arrow batches in pieces of at most ``rows`` rows, so that a worker unpacks few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@functools.lru_cache(maxsize=1)
def mixer():
    """splitmix64's finisher on numpy arrays of uint64."""
    import numpy as np

    def mix(x):
        x = x.astype(np.uint64, copy=True)
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x

    return mix
