"""Exact top-k inner products over norm-sorted vectors.

Components become integers, so scores are exact. Each query gets the ``k`` largest inner
products with all other vectors; ties go to the smaller vec_id.

1. Vectors are sorted by falling length: range-partitioned, then sorted in each partition.
2. The eigenvectors of the sum of outer products (the right singular vectors of the table)
   rotate all vectors, so that leading coordinates hold most of an inner product.
3. The ``SEEDS`` longest vectors give every query a first lower bound for its k-th score.
4. A task takes its vectors in blocks. A block is left out for a query if |q| times its
   longest vector is below the query's bound (Cauchy-Schwarz). The blocks behind it are
   still met: a task may read several files, and those are not in order of length. Else partial sums over leading coordinates plus |rest of q| |rest of x| bound each
   score from above; pairs whose bound stays below are pruned, level after level. Only the
   rest is scored, in integers, and raises the bounds.
5. Each partition returns at most k pairs per query, which are ranked per query.

Bounds are loosened by more than rounding could change them, so pruning never loses a pair.
Queries go in blocks of about ``QUERY_BLOCK``, which are sent to all tasks; each block's
pairs are written before the next block starts.

Cases: a vector that is null or holds a null or non-finite component takes no part, nor
does a row without a vec_id. Shorter vectors count as padded with zeros. Rows that repeat a
vec_id are candidates each, for queries of another vec_id; if a query's id is repeated, its rows
share one list. A query with fewer than k others gets all of them; an empty table gives an
empty result. Large components are summed in Python integers; a score beyond a long, or a
component that alone would lead to one, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, slices

SCALE = 256
SEEDS = 1024
QUERY_BLOCK = 8192
ROW_BLOCK = 256
PAIRS_AT_ONCE = 1 << 16
LEVELS = (0.125, 0.25, 0.5)
SLACK = 1e-9
LARGEST = 2.0**62
TOO_LARGE = "an inner product does not fit a 64-bit integer"


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, norm): integer vectors of the rows that take part."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = lambda c: F.when(F.abs(c) >= LARGEST / SCALE, F.raise_error(F.lit(TOO_LARGE)).cast("bigint")).otherwise(F.floor(SCALE * c))
    v = F.transform(x, lambda c: whole(c.cast("double")))
    rows = rows.filter(x.isNotNull() & F.col(key).isNotNull()).filter(~bad).select(F.col(key).cast("bigint").alias("id"), v.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return rows.select("id", "v", F.sqrt(square).alias("norm"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as float64, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    n = np.diff(ends)
    out = np.zeros((len(n), d))
    at = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], n)
    out[np.repeat(np.arange(len(n)), n), at] = column.values.to_numpy()[ends[0] : ends[-1]]
    return out


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Columns are eigenvectors of the summed outer products, largest first."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column(0), d)
            total += x.T @ x
        i, j = np.indices((d, d))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"]
        )

    gram = np.zeros((d, d))
    sums = rows.select("v").mapInArrow(outer, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    for r in sums.collect():  # d x d numbers
        gram[r["i"], r["j"]] = r["s"]
    _, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return vectors[:, ::-1].copy()


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact row-wise inner products of integer matrices; an error if one does not fit a long."""
    if not a.size:
        return np.zeros(len(a), np.int64)
    most = np.abs(a).max(1) * np.abs(b).max(1) * a.shape[1]
    if most.max() < 2.0**52:
        return np.rint(np.einsum("ij,ij->i", a, b)).astype(np.int64)
    big = np.flatnonzero(most >= 2.0**62)
    out = np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    for i in big:  # few vectors are so long
        score = sum(int(x) * int(y) for x, y in zip(a[i], b[i], strict=True))
        if abs(score) >= 2**63 - 1:
            raise ValueError(TOO_LARGE)
        out[i] = score
    return out


class Search:
    """Queries with their bounds and the best pairs a task has found."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.q, self.k, self.turn = ids, q, k, turn
        self.rotated = q @ turn
        self.norm = np.linalg.norm(q, axis=1)
        self.steps = sorted({max(1, int(q.shape[1] * part)) for part in LEVELS})
        self.rest = [np.linalg.norm(self.rotated[:, s:], axis=1) for s in self.steps]
        self.bound = np.full(len(ids), -np.inf)
        self.pairs = tuple(np.empty(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Meet one block of vectors; one that is too short for every query costs no more than its lengths."""
        norm = np.linalg.norm(x, axis=1)
        live = np.flatnonzero(self.norm * norm.max() * (1 + SLACK) + SLACK >= self.bound)
        if not len(live):
            return
        turned = x @ self.turn
        first = self.steps[0]
        step = max(1, PAIRS_AT_ONCE // len(ids))
        for at in range(0, len(live), step):
            own = live[at : at + step]
            part = self.rotated[own, :first] @ turned[:, :first].T
            i, j = np.nonzero(self.over(part, 0, own[:, None], np.linalg.norm(turned[:, first:], axis=1)[None, :], norm[None, :]))
            qi, part = own[i], part[i, j]
            for level in range(1, len(self.steps)):
                a, b = self.steps[level - 1], self.steps[level]
                part = part + np.einsum("ij,ij->i", self.rotated[qi, a:b], turned[j, a:b])
                keep = self.over(part, level, qi, np.linalg.norm(turned[:, b:], axis=1)[j], norm[j])
                qi, j, part = qi[keep], j[keep], part[keep]
            other = self.ids[qi] != ids[j]
            qi, j = qi[other], j[other]
            self.keep(qi, ids[j], dots(self.q[qi], x[j]))

    def over(self, part, level: int, qi, rest, norm):
        most = part + self.rest[level][qi] * rest
        return most + SLACK * (self.norm[qi] * norm + 1) >= self.bound[qi]

    def keep(self, qi, ids, score) -> None:
        qi, ids, score = (np.concatenate(c) for c in zip(self.pairs, (qi, ids, score), strict=True))
        order = np.lexsort((ids, -score, qi))
        qi, ids, score = qi[order], ids[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        best = rank < self.k
        self.pairs = qi[best], ids[best], score[best]
        last = rank == self.k - 1
        self.bound[qi[last]] = np.maximum(self.bound[qi[last]], score[last])


def search(rows: DataFrame, queries: DataFrame, seeds: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score) of one query block: at least each query's best k."""
    d = turn.shape[0]
    got = queries.select("id", "v").toArrow()
    own = Search(got.column("id").to_numpy(), matrix(got.column("v"), d), turn, k)
    first = seeds.select("id", "v").toArrow()
    for part in slices(first.to_batches(), ROW_BLOCK):
        own.add(part.column(0).to_numpy(), matrix(part.column(1), d))
    # The seeds only give bounds; tasks meet them again among their own rows.
    sent = rows.sparkSession.sparkContext.broadcast((own.ids, own.q, turn, own.bound))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, turn, bound = sent.value
        s = Search(ids, q, turn, k)
        s.bound = bound.copy()
        for part in slices(batches, ROW_BLOCK):
            s.add(part.column(0).to_numpy(), matrix(part.column(1), d))
        qi, vec, score = s.pairs
        yield pa.RecordBatch.from_arrays([pa.array(ids[qi]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    return rows.select("id", "v").mapInArrow(scan, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``."""
    spark = rows.sparkSession
    vectors = usable(rows, key, vector)
    tasks = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    longest = F.col("norm").desc()
    vectors = cut(vectors.repartitionByRange(tasks, longest, F.col("id")).sortWithinPartitions(longest, "id"), "by-norm")
    stats = vectors.agg(F.max(F.size("v")).alias("d"), F.count(F.when(F.col("id") % every == 0, 1)).alias("n")).first()
    folder = shared_dir(spark, "pairs")
    spark.createDataFrame([], "query_id long, vec_id long, score long").write.parquet(f"{folder}/none")
    if stats["d"] and stats["n"]:
        turn = rotation(vectors, stats["d"])
        seeds = cut(vectors.orderBy(longest, "id").limit(SEEDS), "seeds")
        blocks = -(-stats["n"] // QUERY_BLOCK)
        for b in range(blocks):
            own = vectors.filter((F.col("id") % every == 0) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b))
            search(vectors, own, seeds, turn, k).write.parquet(f"{folder}/block={b}")
    elif stats["n"]:  # vectors without components: all scores are zero
        own = vectors.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"))
        least = vectors.select(F.col("id").alias("vec_id")).orderBy("vec_id").limit(k + 1)
        own.join(least, F.col("query_id") != F.col("vec_id")).withColumn("score", F.lit(0).cast("bigint")).write.parquet(f"{folder}/zero")
    found = spark.read.schema("query_id long, vec_id long, score long").option("recursiveFileLookup", "true").parquet(folder)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
