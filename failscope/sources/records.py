"""CSV records of large files, found by many tasks though cells may hold line breaks.

A line alone does not tell whether it starts inside a quoted cell. But what it does to that
question is known: each line is a function from {outside, inside} to itself. Functions chain, so

1. every file split is read as lines and reduced to one such function;
2. running windows over the splits of a file, one row each, give the state each split starts in;
3. the lines are read again, now with that state, and cut into records; what a split has of a
   record that began before it, or goes on behind it, is put together by a grouping.

Quotes count as the parser counts them: a cell is quoted if it starts with a quote, a doubled
quote inside it is text, and behind its end all up to the next comma belongs to it. A quote
inside an unquoted cell is an ordinary character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import cut

CLOSE = re.compile(rb'(?:[^"]|"")*+"')
OUTSIDE, INSIDE = 0, 1
MOST_INSIDE = 1_000_000
BATCH_BYTES = 4_000_000


def after(line: bytes, state: int) -> int:
    """State at the end of a line, the line break included."""
    if b'"' not in line:
        return state
    at = 0
    while True:
        if state == INSIDE:
            end = CLOSE.match(line, at)
            if end is None:
                return INSIDE
            at = end.end()
        comma = line.find(b",", at)
        if comma < 0:
            return OUTSIDE if state == INSIDE or line[at : at + 1] != b'"' else after(line[at + 1 :], INSIDE)
        if state == OUTSIDE and line[at : at + 1] == b'"':
            state, at = INSIDE, at + 1
            continue
        state, at = OUTSIDE, comma + 1


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): lines as bytes, in order inside their split."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


def split_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, from_outside, from_inside) of each split a task reads."""
    found: dict[tuple, list[int]] = {}
    for batch in batches:
        for file, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            state = found.setdefault((file, start), [OUTSIDE, INSIDE])
            if b'"' in line:
                state[:] = [after(line, s) for s in state]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()),
         pa.array([v[0] for v in found.values()], pa.int32()), pa.array([v[1] for v in found.values()], pa.int32())],
        names=["file", "start", "from_outside", "from_inside"],
    )


def inside_splits(splits: DataFrame) -> DataFrame:
    """(file, start) of the splits that start inside a cell.

    A split's function is constant, or passes the state on, or flips it. So the state is the last
    constant, flipped as often as there were flips since.
    """
    flips = (F.col("from_outside") == INSIDE) & (F.col("from_inside") == OUTSIDE)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("start")
    rows = splits.withColumn("n", F.sum(flips.cast("int")).over(upto))
    constant = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside") + F.col("n"))
    rows = rows.withColumn("base", F.coalesce(F.last(constant, ignorenulls=True).over(upto), F.lit(0)))
    # base holds constant + flips up to it; the difference counts flips since.
    state = F.pmod(F.col("base") + F.col("n"), F.lit(2))
    rows = rows.withColumn("state", F.coalesce(F.lag(state).over(before), F.lit(OUTSIDE)))
    return rows.filter(F.col("state") == INSIDE).select("file", "start")


def cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, seq, record, whole, opens, heads) from (file, start, line, inside) rows.

    ``whole`` records begin and end here. ``opens`` marks the first piece of one that goes on,
    ``heads`` the first record of a file.
    """
    out: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_())
        names = ["file", "start", "seq", "record", "whole", "opens", "heads"]
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
        out.clear()
        return made

    split, state, pending, begun, seq = None, OUTSIDE, [], False, 0
    for rows in batches:
        for file, start, line, inside in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if (file, start) != split:
                if pending:
                    out.append((*split, seq, b"\n".join(pending), False, begun, begun and split[1] == 0 and seq == 0))
                split, state, pending, seq = (file, start), INSIDE if inside else OUTSIDE, [], 0
                begun = state == OUTSIDE
            pending.append(line)
            state = after(line, state)
            if state == OUTSIDE:
                record = b"\n".join(pending)
                out.append((*split, seq, record, begun, False, begun and start == 0 and seq == 0))
                size += len(record)
                pending, begun, seq = [], True, seq + 1
            if size > BATCH_BYTES:
                yield batch()
                size = 0
    if pending:
        out.append((*split, seq, b"\n".join(pending), False, begun, begun and split[1] == 0 and seq == 0))
    yield batch()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``, one per row, of CSV files with a header each, without the headers and empty lines."""
    lines = lines_of(spark, path)
    splits = lines.mapInArrow(split_functions, "file long, start long, from_outside int, from_inside int")
    # Only splits that start inside a cell are sent to all tasks: two numbers each.
    inside = cut(inside_splits(splits), "splits")
    if inside.limit(MOST_INSIDE + 1).count() > MOST_INSIDE:
        raise ValueError("too many file splits start inside a cell; raise spark.sql.files.maxPartitionBytes")
    known = F.broadcast(inside.withColumn("inside", F.lit(True)))
    schema = "file long, start long, seq long, record binary, whole boolean, opens boolean, heads boolean"
    found = lines.join(known, ["file", "start"], "left").select(
        "file", "start", "line", F.coalesce("inside", F.lit(False)).alias("inside")
    ).mapInArrow(cut_records, schema)
    found = cut(found, "records")
    along = Window.partitionBy("file").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, 0)
    # At most two pieces per split.
    pieces = found.filter("not whole").withColumn("owner", F.sum(F.col("opens").cast("int")).over(along))
    text = F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "record"))), lambda p: p["record"])
    joined = F.aggregate(text, F.lit(None).cast("binary"), lambda a, p: F.coalesce(F.concat(a, F.lit(b"\n"), p), p))
    joined = pieces.groupBy("file", "owner").agg(joined.alias("record"), F.bool_or("heads").alias("heads"))
    rows = found.filter("whole").select("record", "heads").unionAll(joined.select("record", "heads"))
    record = F.regexp_replace(F.col("record").cast("string"), "\r$", "")
    return rows.filter("not heads").select(record.alias("record")).filter("record <> ''")


def parse_records(records: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the records, by Spark's own CSV parser."""
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.select(F.from_csv("record", columns, options).alias("r")).select("r.*")
