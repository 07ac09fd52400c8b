"""Near-duplicate documents: SuperMinHash, banding, exact verification, components.

A document's set is its distinct word shingles, as 64-bit hashes; a text of fewer words is
one shingle. Two documents are linked if their Jaccard similarity is at least 0.8.

*Signature* (Ertl, 2017): each element walks through the signature in the order of its own
random permutation and offers ``level + uniform`` to the slot it meets, so its ranks are
correlated and no slot is offered two low ranks by one element. A document stops at the
first level that none of its slots can still gain from; sets much larger than the signature
stop at the first. All documents of a batch walk together in numpy.

*Candidates*: equal sets are one class, of which only the smallest doc_id goes on. With 32
bands of 5 values a pair at 0.8 shares no band in 3 of a million cases. A band's documents
are paired with its smallest one only: as many pairs as documents.

*Verification* compares full sets. Pairs with the smallest document are checked by a join.
A family (documents connected through bands) that falls into several linked parts could
hold links between these parts. It is cut into blocks of ``BLOCK`` documents of similar
size and one part or several small ones; block against block is compared inside a task, on
full sets, and only edges that join parts come out. Blocks of the same part, and of sizes
that 0.8 rules out, are not compared. So no pair of a band is left unchecked, and no task
or table holds all pairs; the compared blocks grow with the square of what the first pass
has left apart, not with the family.

Components come from union-find in tasks and star steps between them.

Cases: texts without words are linked with nothing. Rows without a doc_id keep a null
component and are kept. doc_id should be unique: rows that share one are judged each by its
text, and rows that repeat a document wholly are compared once. Empty tables give empty results; extra columns pass through ``clean`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, fits, mixer, slices
from .components import components, unite

WORDS = 5
PERCENT = 80
BANDS = 32
ROWS = 5
BATCH_ELEMENTS = 60_000
BLOCK = 256
BLOCK_ELEMENTS = 100_000
BATCH_ROWS = 500
BROADCAST_IDS = 1_000_000


def shingles(text: str | None, k: int):
    """Sorted distinct shingle hashes. Splits at ASCII white space, folds A-Z only."""
    import numpy as np
    import xxhash

    mix = mixer()
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(h))
    s = h[: len(h) - size + 1]
    for i in range(1, size):
        s = mix(s) + h[i : len(h) - size + 1 + i]
    return np.unique(mix(s + np.uint64(size)))


def superminhash(elements, owner, n_docs: int, m: int):
    """Signatures (n_docs, m) of the sets whose elements are given with their document."""
    import numpy as np

    mix = mixer()
    h = np.full(n_docs * m, np.inf)
    perm = None
    for j in range(m):
        rnd = mix(elements ^ np.uint64((j + 1) * 0xD1342543DE82EF95 & (2**64 - 1)))
        rank = (rnd >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
        k = j + ((mix(rnd) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        at = np.arange(len(elements))
        if perm is None:
            slot = k
        else:
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
        np.minimum.at(h, owner * m + slot, rank)
        # A document whose slots are all below the next level can gain nothing more.
        docs = np.unique(owner)
        going = np.zeros(n_docs, bool)
        going[docs] = h.reshape(n_docs, m)[docs].max(1) >= j + 1
        still = going[owner]
        if perm is None:
            first = k[still]
            perm = np.tile(np.arange(m, dtype=np.uint8), (int(still.sum()), 1))
            perm[np.arange(len(first)), first] = 0
        else:
            perm = perm[still]
        elements, owner = elements[still], owner[still]
        if not len(elements):
            break
    return h.reshape(n_docs, m)


def band_keys(signatures, bands: int, rows: int):
    import numpy as np

    mix = mixer()
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2])
    for i in range(rows):
        key = mix(key ^ bits[:, :, i])
    return key.view(np.int64)


def set_digest(hashes) -> bytes:
    import hashlib

    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, n, digest, bands); digest and bands are null for empty sets, ``key`` is a hash of the text."""
    import numpy as np

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, text_keys, sets):
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = [None] * len(sets)
            if full:
                owner = np.repeat(np.arange(len(full)), [len(sets[i]) for i in full])
                sig = superminhash(np.concatenate([sets[i] for i in full]), owner, len(full), bands * rows)
                for i, key in zip(full, band_keys(sig, bands, rows), strict=True):
                    keys[i] = key
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(text_keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "key", "n", "digest", "bands"],
            )

        for batch in slices(batches, BATCH_ROWS):
            ids, text_keys, sets, held = [], [], [], 0
            for i, text, text_key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingles(text, k)
                ids.append(i)
                text_keys.append(text_key)
                sets.append(s)
                held += len(s)
                if held >= BATCH_ELEMENTS:
                    yield out(ids, text_keys, sets)
                    ids, text_keys, sets, held = [], [], [], 0
            yield out(ids, text_keys, sets)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text")).mapInArrow(
        sign, "doc_id long, key long, n long, digest binary, bands array<long>"
    )


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, set) of the classes in ``wanted`` (node, digest, repeated): one row each."""
    ids = wanted.select(F.col("node").alias("_node"), F.col("digest").alias("_digest"), F.col("repeated").alias("_repeated"))
    ids = F.broadcast(ids) if fits(ids, BROADCAST_IDS) else ids
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text")
    texts = texts.join(ids, F.col("_id") == F.col("_node")).select("_node", "text", "_digest", "_repeated")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, BATCH_ROWS):
            rows = []
            for node, text, digest, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingles(text, k)
                if set_digest(s) == digest:
                    rows.append((node, repeated, s.view(np.int64)))
            types = (pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["node", "repeated", "set"]
            )

    sets = cut(texts.mapInArrow(build, "node long, repeated boolean, set array<long>"), "sets")
    # Rows that hold the same document again are few or none; only they meet to be counted once.
    once = sets.filter("repeated").groupBy("node").agg(F.first("set").alias("set"))
    return sets.filter("not repeated").select("node", "set").unionAll(once)


def alike(n_both, n_a, n_b, percent: int):
    return 100 * n_both >= percent * (n_a + n_b - n_both)


def block_units(members: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of (family, node, comp, n) members, and the pairs of blocks to compare.

    A block holds documents of one size class and of one large part, or of several small
    parts (part -1). It has about ``block`` documents and ``BLOCK_ELEMENTS`` shingles at most,
    dealt by hash, which bounds what a task holds.
    """
    parts = members.groupBy("family", "comp").count().filter(F.col("count") >= block)
    parts = parts.select("family", "comp", F.col("comp").alias("part"))
    rows = members.join(parts, ["family", "comp"], "left").withColumns({
        "part": F.coalesce("part", F.lit(-1)), "class": F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))).cast("int"),
    })
    cell = ["family", "part", "class"]
    cells = rows.groupBy(*cell).agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).alias("pieces"))
    rows = rows.join(cells, cell).withColumn("block", F.xxhash64(*cell, F.pmod(F.xxhash64("node"), F.col("pieces"))))
    rows = cut(rows.select("family", "part", "block", "node", "comp", "n"), "blocks")
    blocks = rows.groupBy("family", "part", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = blocks.select("family", *[F.col(c).alias(c + "2") for c in ("part", "block", "lo", "hi")])
    fits_size = (100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo"))
    pairs = blocks.join(other, "family").filter(
        (F.col("block") <= F.col("block2")) & ((F.col("part") == -1) | (F.col("part") != F.col("part2"))) & fits_size
    )
    return rows, pairs.select(F.xxhash64("block", "block2").alias("unit"), "block", "block2")


def compare_unit(percent: int):
    """Function for one pair of blocks: edges that join different parts."""
    import numpy as np

    def compare(table: pa.Table) -> pa.Table:
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        side = table.column("side").to_numpy()
        sets = table.column("set").combine_chunks()
        ends = sets.offsets.to_numpy()
        n = np.diff(ends)
        value, row = np.unique(sets.values.to_numpy()[ends[0]:ends[-1]], return_inverse=True)
        doc = np.repeat(np.arange(len(n)), n)
        both = np.zeros((len(n), len(n)), np.float32)
        # Only values that two documents hold can count.
        shared = np.flatnonzero(np.bincount(row, minlength=len(value)) > 1)
        place = np.full(len(value), -1)
        place[shared] = np.arange(len(shared))
        row = place[row]
        order = np.argsort(row, kind="stable")
        row, doc = row[order], doc[order]
        for at in range(0, len(shared), 4096):
            a, b = np.searchsorted(row, (at, at + 4096))
            m = np.zeros((len(n), 4096), np.float32)
            m[doc[a:b], row[a:b] - at] = 1
            both += m @ m.T
        hit = alike(both.astype(np.int64), n[:, None], n[None, :], percent) & (comp[:, None] != comp[None, :])
        if side.any():
            hit &= side[:, None] < side[None, :]
        a, b = np.nonzero(hit)
        _, one = np.unique(np.stack([comp[a], comp[b]], 1), axis=0, return_index=True)
        parent: dict[int, int] = {}
        keep = [i for i in one if unite(parent, int(comp[a[i]]), int(comp[b[i]]))]
        return pa.table({"a": pa.array(node[a[keep]], pa.int64()), "b": pa.array(node[b[keep]], pa.int64())})

    return compare


def cross_links(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between different parts of the same family: (a, b), one for each two parts at least."""
    rows, pairs = block_units(members, percent, block)
    full = rows.select("block", "node", "comp").join(sets, "node")
    sides = pairs.select("unit", "block", F.lit(0).alias("side")).unionAll(
        pairs.filter("block <> block2").select("unit", F.col("block2").alias("block"), F.lit(1))
    )
    units = full.join(sides, "block").select("unit", "side", "node", "comp", "set")
    # Written, so that no stage has Python workers for two steps.
    return cut(units.groupBy("unit").applyInArrow(compare_unit(percent), "a long, b long"), "cross-links")


def near_components(
    docs: DataFrame, k: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    return near_rows(docs, k, percent, bands, rows, block).select("doc_id", "n_shingles", "component_id", "kept")


def near_rows(
    docs: DataFrame, k: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """``near_components`` with ``key``, a hash of the row's text, and ``digest``, of its set."""
    sigs = cut(signed(docs, k, bands, rows), "signatures")
    classes = cut(
        sigs.filter("digest is not null and doc_id is not null")
        .groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    keys = classes.select("node", F.explode("bands").alias("key"))
    firsts = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    firsts = cut(firsts, "firsts")
    pairs = cut(keys.join(firsts, "key").filter("node <> first").select("node", "first").distinct(), "pairs")
    nodes = pairs.select("node").unionAll(pairs.select("first")).distinct()
    again = sigs.groupBy("doc_id", "digest").count().filter("count > 1").select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.lit(True).alias("_again")
    )
    same = (F.col("node") == F.col("_id")) & (F.col("digest") == F.col("_digest"))
    nodes = nodes.join(classes.select("node", "digest", "n"), "node").join(again, same, "left")
    nodes = cut(nodes.select("node", "digest", "n", F.coalesce("_again", F.lit(False)).alias("repeated")), "nodes")
    sets = full_sets(docs, nodes, k)
    a = sets.select("node", F.col("set").alias("set_a"))
    b = sets.select(F.col("node").alias("first"), F.col("set").alias("set_b"))
    n_both = F.size(F.array_intersect("set_a", "set_b"))
    links = cut(
        pairs.join(a, "node").join(b, "first")
        .filter(alike(n_both, F.size("set_a"), F.size("set_b"), percent)).select("node", "first"),
        "links",
    )
    part = components(links).withColumnRenamed("node", "p_node")
    family = components(pairs).select(F.col("node").alias("f_node"), F.col("comp").alias("family"))
    members = cut(
        nodes.join(part, nodes.node == F.col("p_node"), "left").join(family, nodes.node == F.col("f_node"), "left")
        .select(F.coalesce("family", "node").alias("family"), "node", F.coalesce("comp", "node").alias("comp"), "n"),
        "members",
    )
    split = members.groupBy("family").agg(
        F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    ).filter("size > 2 and lo <> hi").select("family")
    more = cross_links(members.join(split, "family", "left_semi"), sets, percent, block)
    edges = links.toDF("a", "b").unionAll(more)
    last = components(edges).select(F.col("node").alias("c_node"), "comp")
    of_class = classes.select("digest", "node").join(last, F.col("node") == F.col("c_node"), "left").select(
        "digest", F.coalesce("comp", "node").alias("comp")
    )
    out = sigs.select("doc_id", "key", F.col("n").alias("n_shingles"), "digest").join(of_class, "digest", "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select(
        "doc_id", "key", "digest", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept")
    )


def clean(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component.

    Rows are judged by doc_id and text: one that shares its doc_id with a copy stays. Of rows
    with one doc_id and one set of shingles one stays.
    """
    rows = cut(near_rows(docs, k, percent).select("doc_id", "key", "digest", "kept"), "judged")
    gone = rows.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    sets = rows.filter("kept and doc_id is not null and digest is not null").groupBy("doc_id", "digest").agg(
        F.count("*").alias("n"), F.collect_set("key").alias("keys")
    )
    # Texts of one set are few spellings of the same words.
    again = sets.filter("n > 1").select(F.col("doc_id").alias("_id"), F.explode("keys").alias("_key"), "digest")
    again = cut(again, "repeated")
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    left = docs.join(gone, here, "left_anti")
    one = Window.partitionBy("_id", "_digest").orderBy("_key")
    single = left.join(again.withColumnRenamed("digest", "_digest"), here).withColumn("_n", F.row_number().over(one))
    return left.join(again, here, "left_anti").unionAll(single.filter("_n = 1").select(*docs.columns))
