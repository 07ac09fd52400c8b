"""Line dedup: two Bloom filters find the suspects, only suspects shuffle.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of
at least ``LEAST_CHARS`` code points that at least ``LEAST_DOCS`` documents hold lose all
their lines, except in the largest doc_id that holds them.

1. Each task sends the filter positions of its lines, as packed numbers by filter slice.
   Per slice they are folded into two filters: positions of keys seen once, and of keys
   seen at least twice (all of whose bits were set before). A task counts a key once per
   document, so a line that only one document repeats is no suspect.
2. The filter of twice-seen keys has a fixed size, ``FILTER_BITS`` bits, at any input size;
   that bounds what is sent to the executors. It may name too many suspects, never too
   few: a full filter would only mean that more lines shuffle.
3. Suspects shuffle as (digest of the key, doc_id), are counted exactly, and get the
   document that keeps the line. Digests are SHA-256.
4. Documents get the digests they must drop, and their lines are joined again.

Cases: a null or empty text is one empty line; rows that share a doc_id count as one
document and all drop the same keys; a null doc_id counts as one document and is smaller
than all others; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

LEAST_CHARS = 40
LEAST_DOCS = 5
FILTER_BITS = 1 << 27
SLICES = 64
BATCH_ROWS = 1000
HASHES = 2
BLANK = " \t\n\x0b\x0c\r"
FOLD = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    line = line.strip(BLANK)
    return line.lower() if line.isascii() else line.translate(FOLD)


def long_keys(text: str | None, least: int) -> set[str]:
    """The keys of a text that may count."""
    return {k for line in (text or "").split("\n") if len(line) >= least and len(k := line_key(line)) >= least}


def places(keys, bits: int):
    """Filter positions of keys: an array of HASHES columns."""
    import numpy as np
    import xxhash

    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) % np.uint64(bits) for i in range(HASHES)], 1).astype(np.uint32)


def twice_filter(docs: DataFrame, least: int, bits: int = FILTER_BITS) -> list:
    """Slices of the filter of keys that at least two documents seem to hold."""
    import numpy as np

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for text in batch.column(0).to_pylist() for k in long_keys(text, least)]
            at = places(keys, bits)
            # All positions of a key go to the slice of its first one.
            home = at[:, 0] // (bits // SLICES)
            inside = (home.astype(np.uint32) * np.uint32(bits // SLICES))[:, None] + at % np.uint32(bits // SLICES)
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(SLICES + 1))
            rows = [(s, inside[order[cuts[s]:cuts[s + 1]]].tobytes()) for s in range(SLICES) if cuts[s] < cuts[s + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "at"]
            )

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = bits // SLICES
        once, twice = np.zeros(width, bool), np.zeros(width, bool)
        for batch in batches:
            for packed in batch.column("at").to_pylist():
                at = (np.frombuffer(packed, np.uint32) % np.uint32(width)).reshape(-1, HASHES)
                keys, n = np.unique(at, axis=0, return_counts=True)
                again = once[keys].all(1) | (n > 1)
                twice[keys[again].ravel()] = True
                # Other keys of this packet may together cover a key's bits; that adds a suspect.
                once[keys.ravel()] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["slice", "bits"]
        )

    sent = docs.select("text").mapInArrow(send, "slice int, at binary")
    found = sent.groupBy("slice").applyInArrow(fold, "slice int, bits binary").collect()
    empty = bytes(-(-(bits // SLICES) // 8))
    by = {r["slice"]: bytes(r["bits"]) for r in found}
    return [by.get(s, empty) for s in range(SLICES)]


def suspects(docs: DataFrame, least: int, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, digest) of every key whose bits are all in the filter of twice-seen keys."""
    import hashlib

    import numpy as np

    sent = docs.sparkSession.sparkContext.broadcast(b"".join(twice_filter(docs, least, bits)))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(sent.value, np.uint8)
        width = np.uint32(bits // SLICES)
        for batch in slices(batches, BATCH_ROWS):
            ids, out_id, out_digest = batch.column(0).to_pylist(), [], []
            keys, owner = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = long_keys(text, least)
                keys += own
                owner += [i] * len(own)
            at = places(keys, bits)
            inside = (at[:, :1] // width) * width + at % width
            hit = ((twice[inside >> 3] >> (7 - (inside & 7)).astype(np.uint8)) & 1).all(1)
            for k in np.flatnonzero(hit):
                out_id.append(ids[owner[k]])
                out_digest.append(hashlib.sha256(keys[k].encode()).digest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_id, pa.int64()), pa.array(out_digest, pa.binary())], ["doc_id", "digest"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(test, "doc_id long, digest binary")


def dropped_keys(docs: DataFrame, least: int, least_docs: int, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, drop): digests of the keys whose lines a document loses."""
    maybe = cut(suspects(docs, least, bits).distinct(), "suspects")
    # Written, as adaptive execution splits a hot key only between two plain tables.
    common = cut(
        maybe.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= least_docs).select("digest", "keeper"),
        "common-lines",
    )
    return (
        maybe.join(common, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id").agg(F.collect_set("digest").alias("drop"))
    )


def dedup(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each row of ``docs`` with the lines it keeps."""
    import hashlib

    drop = dropped_keys(docs, least, least_docs, bits).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.join(drop, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "drop")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            texts, n, gone = [], [], []
            for text, lost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                keep = lines
                if lost:
                    lost = set(lost)
                    keep = [
                        x for x in lines
                        if len(x) < least or len(k := line_key(x)) < least or hashlib.sha256(k.encode()).digest() not in lost
                    ]
                texts.append("\n".join(keep))
                n.append(len(lines))
                gone.append(len(lines) - len(keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

    return rows.mapInArrow(rebuild, "doc_id long, text string, n_lines long, n_dropped long")
