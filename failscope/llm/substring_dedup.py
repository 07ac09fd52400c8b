"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text: each byte adds its random number to the
doubled hash, and the hash at a byte depends on the ``REACH`` bytes that end there. A cut
follows each byte whose (mixed) hash is the largest among its ``SPAN`` neighbours on either
side. Cuts depend on nearby bytes only, so an insertion moves at most the chunks around it;
the maximum rule keeps chunk lengths close to ``2 * SPAN``. Texts without such maxima (one
pattern over and over) are cut every ``LONGEST`` bytes. No character is cut through.

Chunks are compared by a 128-bit digest. A digest that two or more documents hold is
repeated; neighbouring repeated chunks form a run, and runs of at least ``LEAST_BYTES``
count as repeated passages. A run falls short of the passage it lies in by the bytes around
its ends that decide on cuts, so a passage of about 50 words leaves a run well above that.

The first place of a chunk (smallest doc_id, then smallest start) keeps it. Runs decide on
length only: the chunks of one run may have several keepers, so a run is marked in
stretches of one keeper, and what is cut is never a chunk at its own first place. With
``inside``, a chunk that one text holds at two places is repeated as well.

Digests are summed up before they shuffle (first and last place), so a passage that
a third of all documents share is one row per task. The join back to the chunks is a plain
equi-join whose hot keys adaptive execution splits.

Cases: null and empty texts have no chunks; rows without a doc_id take no part; rows that
share a doc_id are one document, so they repeat nothing of each other, but each text has
its own places. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mixer

REACH = 16
SPAN = 16
LONGEST = 1024
LEAST_BYTES = 100
SLICE_BYTES = 1 << 20


def gear_table() -> np.ndarray:
    return (mixer()(np.arange(256, dtype=np.uint64) + np.uint64(2024)) >> np.uint64(32)).astype(np.uint32)


def shifted(x: np.ndarray, by: int, fill: int = 0) -> np.ndarray:
    out = np.full_like(x, fill)
    out[by:] = x[:-by] if by < len(x) else x[:0]
    return out


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Sum of gear[b] << age over the last REACH bytes, for each byte."""
    h = gear_table()[data]
    width = 1
    while width < REACH:
        h = h + (shifted(h, width) << np.uint32(width))
        width *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def past_max(x: np.ndarray, span: int) -> np.ndarray:
    """Largest of the ``span`` values before each place (a power of two)."""
    m, width = shifted(x, 1), 1
    while width < span:
        m = np.maximum(m, shifted(m, width))
        width *= 2
    return m


def cut_points(texts: list[bytes]) -> list[np.ndarray]:
    """Chunk ends of each text, its own end included."""
    gap = bytes(REACH + SPAN)
    data = np.frombuffer(gap.join([b"", *texts, b""]), np.uint8)
    h = gear_hash(data)
    top = (h > past_max(h, SPAN)) & (h >= past_max(h[::-1], SPAN)[::-1])
    begins = np.append((data[1:] & 0xC0) != 0x80, True)
    after = np.flatnonzero(top & begins) + 1
    out, at = [], len(gap)
    for text in texts:
        a, b = np.searchsorted(after, (at + 1, at + len(text)))
        ends = np.append(after[a:b] - at, len(text)) if text else np.empty(0, np.int64)
        if len(ends) and np.diff(ends, prepend=0).max() > LONGEST:
            ends = split_long(text, ends)
        out.append(ends)
        at += len(text) + len(gap)
    return out


def split_long(text: bytes, ends: np.ndarray) -> np.ndarray:
    out, start = [], 0
    for end in ends:
        while end - start > LONGEST:
            start += LONGEST
            while text[start] & 0xC0 == 0x80:
                start -= 1
            out.append(start)
        out.append(end)
        start = end
    return np.array(out)


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, start, stop, digest): all chunks, in bytes; ``copy`` tells texts of one doc_id apart."""

    def rows(ids, copies, texts):
        import hashlib

        starts, stops, digests, owner, copy = [], [], [], [], []
        for i, c, text, ends in zip(ids, copies, texts, cut_points(texts), strict=True):
            at = [0, *ends[:-1].tolist()] if len(ends) else []
            ends = ends.tolist()
            digests += [hashlib.md5(text[a:b], usedforsecurity=False).digest() for a, b in zip(at, ends, strict=True)]
            starts += at
            stops += ends
            owner += [i] * len(ends)
            copy += [c] * len(ends)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip((owner, copy, starts, stops, digests), kinds, strict=True)],
            ["doc_id", "copy", "start", "stop", "digest"],
        )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, texts, held = [], [], [], 0
            for i, c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                copies.append(c)
                texts.append(text)
                held += len(text)
                if held >= SLICE_BYTES:
                    yield rows(ids, copies, texts)
                    ids, copies, texts, held = [], [], [], 0
            yield rows(ids, copies, texts)

    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("copy"), "text")
    return docs.mapInArrow(split, "doc_id long, copy long, start int, stop int, digest binary")


def runs(docs: DataFrame, least: int = LEAST_BYTES, inside: bool = False) -> DataFrame:
    """Repeated passages: (doc_id, copy, start, stop, n_chunks, keeper, parts).

    ``parts`` are the run's stretches (start, stop, n_chunks, keeper, dropped), each of
    chunks that one document keeps; ``dropped`` is false at the first place of its chunks.
    """
    parts = chunks(docs)
    place = F.struct("doc_id", "copy", "start")
    again = F.col("first.doc_id") != F.col("last.doc_id")
    if inside:
        again |= F.col("twice")
    # Written, as adaptive execution splits a hot digest only between two plain tables.
    common = cut(
        parts.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .withColumn("twice", (F.col("first.copy") == F.col("last.copy")) & (F.col("first.start") < F.col("last.start")))
        .filter(again).select("digest", "first"),
        "common-chunks",
    )
    per_text = parts.join(common, "digest").groupBy("doc_id", "copy").agg(
        F.sort_array(F.collect_set(F.struct(
            "start", "stop", F.col("first.doc_id").alias("keeper"),
            # Another text of the keeper's doc_id is the same document and repeats nothing.
            F.when(F.col("first.doc_id") != F.col("doc_id"), True)
            .otherwise((F.col("first.copy") == F.col("copy")) & (F.col("first.start") < F.col("start")) & F.lit(inside)).alias("dropped"),
        ))).alias("hits")
    )

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, copy, hits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                run = None
                for x in [*hits, {"start": -1, "stop": -1, "keeper": 0, "dropped": False}]:
                    part = {**x, "n_chunks": 1}
                    if run and run[3] == x["start"]:
                        run[3:6] = x["stop"], run[4] + 1, min(run[5], x["keeper"])
                        last = run[6][-1]
                        if (last["keeper"], last["dropped"]) == (x["keeper"], x["dropped"]):
                            last["stop"] = x["stop"]
                            last["n_chunks"] += 1
                        else:
                            run[6].append(part)
                        continue
                    if run and run[3] - run[2] >= least:
                        out.append(run)
                    run = [doc, copy, x["start"], x["stop"], 1, x["keeper"], [part]]
            stretch = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("n_chunks", pa.int32()), ("keeper", pa.int64()), ("dropped", pa.bool_())])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(stretch))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                ["doc_id", "copy", "start", "stop", "n_chunks", "keeper", "parts"],
            )

    return per_text.mapInArrow(
        join_up,
        "doc_id long, copy long, start int, stop int, n_chunks int, keeper long, "
        "parts array<struct<start: int, stop: int, n_chunks: int, keeper: long, dropped: boolean>>",
    )


def repeats(docs: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Passages that documents share: (doc_id, start, stop, n_chunks, keeper), in bytes.

    ``keeper`` is the smallest of the documents that keep the passage's chunks; only its
    ``stretches`` say which chunks that are.
    """
    return runs(docs, least).select("doc_id", "start", "stop", "n_chunks", "keeper")


def stretches(docs: DataFrame, least: int = LEAST_BYTES, inside: bool = True) -> DataFrame:
    """(doc_id, copy, start, stop, n_chunks, keeper, dropped): repeated passages in pieces with one keeper."""
    return runs(docs, least, inside).select("doc_id", "copy", F.inline("parts"))


def dedup(docs: DataFrame, least: int = LEAST_BYTES, inside: bool = True) -> DataFrame:
    """(doc_id, text, n_cut): texts without the stretches that are kept elsewhere."""
    lost = stretches(docs, least, inside).filter("dropped").groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_copy"))
    rows = rows.join(lost, same, "left").select("doc_id", "text", "spans")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, at, keep = (text or "").encode(), 0, []
                for x in spans or []:
                    keep.append(raw[at : x["start"]])
                    at = x["stop"]
                texts.append(b"".join([*keep, raw[at:]]).decode())
                n.append(len(spans or []))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["doc_id", "text", "n_cut"]
            )

    return rows.mapInArrow(build, "doc_id long, text string, n_cut long")
