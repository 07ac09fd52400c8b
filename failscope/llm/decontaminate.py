"""Benchmark decontamination by a prefix-filtered containment join.

A window is ten consecutive words of a benchmark item (the whole item, if it is shorter).
A document contains a window if all its words follow each other there.

- *Tokens* of a window are its shingles of three words (fewer only if it has fewer words).
- *Rarity*: the shingles of all windows are counted over all documents, and each window's
  are ordered by that count.
- *Prefix*: containment of a whole window needs every shingle, so the prefix that must
  match has length one: its rarest shingle. Only that one is joined.
- *Length and positional bounds*: a match fixes where the window would have to begin; it
  must neither begin before the document nor end behind it.
- *Verification* compares the words themselves, so hash collisions cost time only.

Documents never move: positions are generated inside the row, meet the prefix table there,
and only hits (and one row per document) are grouped. The prefix table is broadcast only if
it has at most ``BROADCAST_WINDOWS`` windows; beyond that positions are shuffled by their
shingle hash, and the candidates fetch the words of both sides.

Cases: a null or empty text has no words and no hits; an item without words has no windows;
a null item_id reads as "null". A document is a doc_id with a text: repeats of such a row
give one row, different texts under one doc_id a row each. Extra columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fits

WINDOW = 10
SHINGLE = 3
BROADCAST_WINDOWS = 50_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    plain = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(plain, NO_WORD), "")


def shingle_at(words: Column, at: Column, k: int) -> Column:
    """Hash of the k words from position ``at``; null where they would run over the end."""
    parts = [F.get(words, at + i) for i in range(k)]
    return F.when(at + k <= F.size(words), F.xxhash64(F.lit(k), *parts))


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: (win, items), with the items that hold them, as strings."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("w")
    ).filter(F.size("w") > 0)
    slices = F.transform(F.sequence(F.lit(0), F.size("w") - window), lambda i: F.slice("w", i + 1, F.lit(window)))
    whole = F.array(F.col("w"))
    return (
        items.select("item", F.explode(F.when(F.size("w") <= window, whole).otherwise(slices)).alias("win"))
        .groupBy("win")
        .agg(F.collect_set("item").alias("items"))
    )


def document_words(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"), F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words")
    )


def positions(words: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each word position and shingle size; at least one for each document."""
    at = words.select("*", F.posexplode_outer("words").alias("p", "word")).drop("word")
    if len(sizes) == 1:
        return at.withColumn("key", shingle_at(F.col("words"), F.col("p"), sizes[0]))
    keys = F.array(*[shingle_at(F.col("words"), F.col("p"), k) for k in sizes])
    return at.withColumn("key", F.explode(keys))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """Occurrences of windows: (doc_id, text_key, n_words, start, len, items).

    Each document also has a row whose ``start`` is null, so that those without hits stay.
    """
    wins = cut(windows_of(benchmark, window), "windows").withColumn("len", F.size("win"))
    wins = wins.withColumns({"k": F.least(F.lit(SHINGLE), "len"), "wid": F.xxhash64("win")})
    sizes = sorted(r[0] for r in wins.select("k").distinct().collect()) or [SHINGLE]  # 1 to SHINGLE
    small = fits(wins, limit)
    sent = F.broadcast if small else (lambda df: df)
    inside = wins.select("*", F.posexplode("win").alias("off", "_w")).drop("_w")
    chain = reduce(
        lambda c, k: c.when(F.col("k") == k, shingle_at(F.col("win"), F.col("off"), k)), sizes, F.when(F.lit(False), 0)
    )
    inside = inside.withColumn("key", chain).filter("key is not null")
    words = document_words(docs)
    counts = (
        positions(words, sizes).select("key").join(sent(inside.select("key").distinct()), "key", "left_semi")
        .groupBy("key").agg(F.count("*").alias("df"))
    )
    rarest = inside.join(counts, "key", "left").groupBy("wid", "win", "len", "items").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "key")).alias("first")
    )
    prefix = cut(rarest.select("wid", "win", "len", "items", "first.off", "first.key"), "prefix")
    start = F.col("p") - F.col("off")
    in_bounds = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = F.slice("words", start + 1, F.col("len")) == F.col("win")
    words = words.withColumn("n_words", F.size("words").cast("bigint"))
    bare = [F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"),
            F.lit(None).cast("array<string>").alias("items")]
    if small:
        hit = in_bounds & same
        found = positions(words, sizes).join(F.broadcast(prefix), "key", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
        found = found.filter(F.col("hit") | (F.coalesce("p", F.lit(0)) == 0))
        return found.select("doc_id", "text_key", "n_words", *[F.when(F.col("hit"), c).alias(n) for c, n in
                                                              ((start, "start"), (F.col("len"), "len"), (F.col("items"), "items"))])
    maybe = (
        positions(words, sizes).select("doc_id", "text_key", "n_words", "p", "key").filter("key is not null")
        .join(prefix.select("wid", "len", "off", "key"), "key").filter(in_bounds)
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "wid", start.alias("start")).distinct()
    )
    found = (
        maybe.join(words, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
        .select("doc_id", "text_key", "n_words", "words", "start", "wid")
        .join(prefix.select("wid", "win", "len", "items"), "wid")
        .filter(F.slice("words", F.col("start") + 1, F.col("len")) == F.col("win"))
        .select("doc_id", "text_key", "n_words", "start", "len", "items")
    )
    return found.unionByName(words.select("doc_id", "text_key", "n_words", *bare))


def covered(spans: Column) -> Column:
    """Number of positions in the union of (start, stop) spans."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], acc["to"]))).alias("n"),
        F.greatest(acc["to"], x["stop"]).alias("to"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, items (sorted)."""
    at = F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("len")).alias("stop")))
    return (
        hits(docs, benchmark, window, limit)
        .groupBy("doc_id", "text_key")
        .agg(
            F.max("n_words").alias("n_words"),
            F.collect_set(at).alias("spans"),
            F.collect_set("items").alias("items"),
        )
        .select(
            "doc_id", "text_key", "n_words", covered(F.col("spans")).cast("bigint").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    bad = report(docs, benchmark, window, limit).filter("n_hit > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    )
    hit = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    return docs.join(bad, hit, "left_anti")
