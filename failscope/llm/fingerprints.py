"""Document fingerprints: one-permutation MinHash with optimal densification, packed.

A text's set is its word shingles (five words; a shorter text is one shingle). Each shingle
is hashed once: the top bits of the hash choose one of ``BINS`` bins, the rest is its rank
there, and a bin keeps its smallest. Sorting the hashes puts a bin's smallest first.

*Optimal densification* (Shrivastava, 2017): an empty bin probes the bins in a random order
of its own, the same for all texts, and takes the value of the first that is not empty. The
order is that of a hash of (bin, probed bin), so the first one is a minimum over the filled
bins and no loop of attempts is needed, however few bins are filled.

A fingerprint holds the low ``BITS`` bits of each bin's value as hex. Two unequal values agree
in them once in 2 ** BITS, so the share of equal bins m estimates the similarity as
(m - c) / (1 - c), c = 2 ** -BITS, and 0 at least.

*Next document*: rows are dealt to buckets by key ranges and meet their successor in a window
inside the bucket. A bucket's first row is also sent, as a guest, to the bucket before it, the
first of all to the last bucket. Texts shuffle once. Bounds come from a range sort of the keys
(doc_id and a hash of the text), one for each shuffle partition, so that repeated ids split too.

All of it is column expressions; nothing leaves the JVM.

Cases: a null text counts as empty. A text without words has the empty fingerprint, whose
likeness is 1 to another empty one and 0 to any other. Rows without a doc_id come first; rows
that share one are ordered by a hash of their text, then by text. Repeated rows stay, each the
next of the other; only wholly equal rows can never be split over buckets. A single row is its
own next document. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

BIN_BITS = 7
BINS = 2**BIN_BITS
BITS = 8
WORDS = 5
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though a lambda may use it often."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BLANKS), "")


def shingle_hashes(words: Column, k: int = WORDS) -> Column:
    n = F.size(words)
    at = lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])
    short = F.array(F.xxhash64(F.lit(0), F.array_join(words, " ")))
    return (
        F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, short)
        .otherwise(F.transform(F.sequence(F.lit(0), n - k), at))
    )


def bin_of(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BIN_BITS).cast("int")


def minima(hashes: Column) -> Column:
    """Each filled bin's smallest hash. Hashes of one bin are neighbours once sorted."""
    def firsts(s: Column) -> Column:
        new = lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))
        return F.filter(s, new)

    return let(F.sort_array(hashes), firsts)


def densified(values: Column) -> Column:
    """BINS values: each bin's own or that of the filled bin it probes first."""
    def fill(bins: Column) -> Callable[[Column], Column]:
        # A probe's hash, with the place among the filled bins in its low bits.
        probe = lambda j: lambda b, i: F.xxhash64(j, b).bitwiseAND(F.lit(-BINS)).bitwiseOR(i.cast("bigint"))
        donor = lambda j: F.array_min(F.transform(bins, probe(j))).bitwiseAND(F.lit(BINS - 1)).cast("int")
        return lambda j: let(
            F.array_position(bins, j),
            lambda at: F.get(values, F.when(at > 0, (at - 1).cast("int")).otherwise(donor(j))),
        )

    return let(F.transform(values, bin_of), lambda bins: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), fill(bins)))


def fingerprint(text: Column) -> Column:
    """Packed low bits as lowercase hex; empty for a text without words."""
    low = lambda v: F.lower(F.substring(F.hex(v.bitwiseAND(F.lit(2**BITS - 1)) + 2**BITS), 2, BITS // 4))
    pack = lambda v: F.when(F.size(v) == 0, F.lit("")).otherwise(F.array_join(F.transform(densified(v), low), ""))
    return let(words_of(text), lambda w: let(minima(shingle_hashes(w)), pack))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the sets behind two fingerprints, corrected for chance agreement."""
    width = BITS // 4
    piece = lambda s, i: F.substr(s, i * width + 1, F.lit(width))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: piece(a, i) == piece(b, i))) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return (
        F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))
    )


def key_of(doc_id: str, text: Column) -> Column:
    """Sort key: null ids first, then by id, then by a hash of the text."""
    known = F.col(doc_id).isNotNull().cast("int")
    return F.struct(known.alias("known"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(text).alias("hash"))


def lower_bounds(keys: DataFrame) -> list:
    """Smallest key of each range of keys: as many as there are shuffle partitions, at most."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
    return sorted(tuple(r["key"]) for r in ranges.collect())


def with_next(rows: DataFrame, bounds: list, carried: dict[str, str]) -> DataFrame:
    """``rows`` (key, ...) with columns of their successor; ``carried`` names them."""
    literal = F.array(*[F.struct(F.lit(k).alias("known"), F.lit(i).cast("bigint").alias("id"), F.lit(h).cast("bigint").alias("hash"))
                        for k, i, h in bounds])
    rows = rows.withColumn("_bucket", F.size(F.filter(literal, lambda b: b <= F.col("key"))) - 1)
    first = F.get(literal, F.col("_bucket")) == F.col("key")
    home = F.struct(F.lit(0).alias("guest"), F.col("_bucket").alias("bucket"))
    guest = F.struct(F.lit(1).alias("guest"), F.pmod(F.col("_bucket") - 1, F.lit(len(bounds))).alias("bucket"))
    dealt = rows.withColumn("_to", F.explode(F.when(first, F.array(home, guest)).otherwise(F.array(home))))
    order = Window.partitionBy("_to.bucket").orderBy("_to.guest", "key", "text")
    dealt = dealt.withColumns({new: F.lead(c).over(order) for c, new in carried.items()})
    return dealt.filter("_to.guest = 0").drop("_bucket", "_to")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the text with its last half replaced by as many first code points of
    the next document, or by all of it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    bounds = lower_bounds(docs.select(key_of(doc_id, whole).alias("key")))
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), whole.alias("text"), key_of(doc_id, whole).alias("key"),
        fingerprint(whole).alias("fingerprint"),
    )
    if not bounds:
        bounds = [(0, 0, 0)]
    rows = with_next(rows, bounds, {"text": "next_text", "fingerprint": "next_fingerprint"})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    # Columns that are used more than once are each a step of their own.
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    rows = rows.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint",
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
