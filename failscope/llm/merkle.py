"""Merkle manifest of a table: a hash tree per language, one tree over their roots, proofs.

Every row is a leaf. The leaves of a language, ordered by doc_id, are hashed two by two
until one node, the subroot, is left; the subroots give the root in the same way.

*Rank* comes from one range sort of the keys: a row's place inside its sorted partition plus
what earlier partitions hold of its language, so no task ranks a whole language.

*Rollup*: the rank's low ``BITS`` binary digits are columns. Rows are dealt by (tree, block),
where a block is 2 ** BITS consecutive ranks, and then one digit column after the other is
grouped away: each grouping nests the children below it as structs and hashes their hashes.
All groupings of a block stay in the partition it was dealt to. A block's root is a leaf of
the next round, which is 2 ** BITS times smaller; languages and rounds are alike to it.

*Proofs*: a nested transform walks down a block's structs, each level adding the siblings it
passes, and an explode returns one row per leaf. Inside a block no join is needed; a block
learns the siblings above it by one row of the round above.

Cases: null fields are hashed as ``-``. Rows with a null lang form a tree of their own, the
first one; an empty lang is another. Rows without a doc_id come first and are never tampered
with. Rows that share a doc_id are ordered by their leaf; repeated rows are leaves each. An
empty table has no leaves and gives no rows. Only the five named columns are read; others may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fits

BITS = 10
TAMPER_EVERY = 7
BROADCAST_PIECES = 100_000
STEPS = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    """Leaf of a row; ``n_chars`` is given apart, as it is what gets tampered with."""
    first = [F.col("doc_id").cast("bigint"), F.col("source"), F.col("lang")]
    return digest(F.concat(*map(field, [*first, n_chars, F.col("text")])))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, hash, bent): ``bent`` is the leaf after tampering, null for untouched rows."""
    doc_id = F.col("doc_id").cast("bigint")
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    hit = F.crc32(doc_id.cast("string").cast("binary")) % TAMPER_EVERY == 0
    return docs.select(
        # Sorts a null lang before all others, and others bytewise.
        F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit("n")).alias("tree"),
        doc_id.alias("doc_id"), leaf(n_chars).alias("hash"), F.when(hit, leaf(n_chars + 1)).alias("bent"),
    )


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0, inside ``tree``) and ``n`` (rows of the tree)."""
    placed = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)  # as monotonically_increasing_id is documented
    before = Window.partitionBy("tree").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition and tree in it: a window over partitions, not over rows.
    pieces = placed.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    pieces = cut(pieces.select(
        "tree", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("n"),
    ), "pieces")
    pieces = F.broadcast(pieces) if fits(pieces, BROADCAST_PIECES) else pieces
    return placed.withColumn("_part", part).join(pieces, ["tree", "_part"]).select(
        "tree", (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"), "n", *[c for c in rows.columns if c != "tree"]
    )


def joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["hash"]), "")


def nested(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, block, n, node): each block of (tree, rank, n, hash, value) nodes as one struct.

    A level that a tree no longer needs (it has one node left) passes its only child on.
    """
    digits = [f"d{i}" for i in range(bits)]
    rows = nodes.select(
        "tree", F.shiftright("rank", bits).alias("block"), "n",
        *[F.shiftright("rank", i).bitwiseAND(F.lit(1)).cast("int").alias(d) for i, d in enumerate(digits)],
        F.struct("hash", "value").alias("node"),
    ).repartition("tree", "block")
    for level, d in enumerate(digits):
        kids = F.array_sort(F.collect_list(F.struct(d, "node")))
        rows = rows.groupBy("tree", "block", "n", *digits[level + 1 :]).agg(kids.alias("kids"))
        rows = rows.withColumn("kids", F.transform("kids", lambda k: k["node"]))
        own = F.when(F.col("n") > 2**level, digest(joined(F.col("kids")))).otherwise(F.col("kids")[0]["hash"])
        rows = rows.withColumn("node", F.struct(own.alias("hash"), "kids")).drop("kids")
    return rows


def leaves_below(node: Column, n: Column, level: int, path: Column) -> Column:
    """array<struct<value, hash, path>> of a struct of ``nested``; ``path`` is what is above it."""
    if level == 0:
        return F.array(F.struct(node["value"].alias("value"), node["hash"].alias("hash"), path.alias("path")))
    kids = node["kids"]

    def down(kid: Column, i: Column) -> Column:
        left = F.when(i > 0, kids[0]["hash"]).otherwise("")
        right = F.coalesce(F.get(kids, i + 1)["hash"], F.lit(""))
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        own = F.when(n > 2 ** (level - 1), step).otherwise(F.array().cast(STEPS))
        return leaves_below(kid, n, level - 1, F.concat(own, path))

    return F.flatten(F.transform(kids, down))


def rollup(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Tables of nested blocks, round by round, until every tree is one block."""
    rounds = []
    while True:
        rounds.append(cut(nested(nodes, bits), "blocks"))
        more = rounds[-1].filter(F.col("n") > 2**bits)
        if more.isEmpty():
            return rounds
        nodes = more.select(
            "tree", F.col("block").alias("rank"), F.ceil(F.col("n") / 2**bits).alias("n"),
            F.col("node.hash").alias("hash"), F.col("block").alias("value"),
        )


def roots(rounds: list[DataFrame], bits: int) -> DataFrame:
    """(tree, hash) of every tree."""
    done = [r.filter(F.col("n") <= 2**bits).select("tree", F.col("node.hash").alias("hash")) for r in rounds]
    out = done[0]
    for df in done[1:]:
        out = out.unionAll(df)
    return out


def proofs(rounds: list[DataFrame], bits: int, tops: DataFrame) -> DataFrame:
    """(tree, value, hash, path, top) of every leaf, from the last round down to the first.

    ``tops`` has (tree, path, top): the siblings above each tree's root, and what to pass on.
    """
    above = None
    for i in range(len(rounds) - 1, -1, -1):
        blocks = rounds[i].filter(F.col("n") <= 2**bits).join(tops, "tree")
        if above is not None:
            known = above.select("tree", F.col("value").alias("block"), "path", "top")
            blocks = blocks.unionByName(rounds[i].filter(F.col("n") > 2**bits).join(known, ["tree", "block"]))
        found = F.explode(leaves_below(F.col("node"), F.col("n"), bits, F.col("path"))).alias("leaf")
        above = blocks.select("tree", "top", found).select("tree", "leaf.*", "top")
        if i:
            above = cut(above, "paths")
    return above


def manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, leaf, bent, path, subroot, root), a row per row of ``docs``.

    ``path`` lists the siblings from the leaf to the root as (left, right) pairs of hex texts.
    """
    rows = ranked(leaves(docs), "doc_id", "hash").withColumn("value", F.struct("doc_id", "bent"))
    rounds = rollup(rows.drop("doc_id", "bent"), bits)
    subroots = roots(rounds, bits).select(F.lit("all").alias("tree"), F.col("tree").alias("value"), "hash")
    upper = rollup(ranked(subroots, "value"), bits)
    start = roots(upper, bits).select("tree", F.array().cast(STEPS).alias("path"), F.col("hash").alias("top"))
    tops = proofs(upper, bits, start).select(
        F.col("value").alias("tree"), "path", F.struct(F.col("hash").alias("subroot"), F.col("top").alias("root")).alias("top")
    )
    return proofs(rounds, bits, cut(tops, "tops")).select(
        "value.doc_id", F.col("hash").alias("leaf"), "value.bent", "path", "top.subroot", "top.root"
    )


def folded(leaf_hash: Column, path: Column) -> Column:
    """Root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf_hash, lambda h, p: digest(F.concat(p["left"], h, p["right"])))


def audit(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Every leaf with its proof's hash, and whether the (possibly tampered) leaf still leads to the root."""
    rows = manifest(docs, bits)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    rows = rows.withColumns({
        "proof_sha256": digest(siblings), "folded_root": folded(F.coalesce("bent", "leaf"), F.col("path")),
    })
    return rows.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
