"""Text and category features.

Two forms: long tables (document, term, weight), which any engine can check, and
Spark ML stages for the models.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.store import cut

# Words are runs of two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0))


def terms(tokens: Column, bigrams: bool = True) -> Column:
    """Words, followed by pairs of neighbouring words."""
    if not bigrams:
        return tokens
    n = F.size(tokens)
    head = F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tail = F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.concat(tokens, F.zip_with(head, tail, lambda a, b: F.concat_ws(" ", a, b)))


def tokenize_terms(df: DataFrame, text: str, bigrams: bool = True) -> DataFrame:
    """Add ``terms`` (array) to every row."""
    return df.withColumn("_words", words(text)).withColumn("terms", terms(F.col("_words"), bigrams)).drop("_words")


def english_stop_words(spark: SparkSession) -> list[str]:
    """Spark's own English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def remove_stop_words(tokens: Column, stop_words: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(stop_words))


def term_counts(df: DataFrame, doc: str, term_array: str = "terms") -> DataFrame:
    """(doc, term, tf), without a shuffle.

    A document is one row, so its terms are sorted inside the row, where equal ones form
    runs; the length of a run is the count. Grouping exploded terms by (document,
    term) would give the same at the price of hashing and shuffling every term.
    """
    sorted_terms = df.select(doc, F.sort_array(term_array).alias("_s"))
    at = F.col("_s")
    n = F.size("_s")
    new_run = lambda i: (i == 0) | (F.get(at, i) != F.get(at, i - 1))
    # No filter on the array: it would be pushed to the scan and tokenize twice.
    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    runs = sorted_terms.select(doc, "_s", F.filter(positions, new_run).alias("_starts"))
    entries = F.transform(
        "_starts",
        lambda start, k: F.struct(
            F.get(at, start).alias("term"),
            (F.coalesce(F.get(F.col("_starts"), k + 1), n) - start).cast("bigint").alias("tf"),
        ),
    )
    return runs.select(doc, F.inline(entries))


def term_statistics(counts: DataFrame) -> DataFrame:
    """(term, total, df) from (doc, term, tf)."""
    return counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))


def vocabulary_topk(statistics: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent terms of the corpus; ties in term order."""
    return statistics.orderBy(F.desc("total"), "term").limit(k)


TRACKED_PER_TERM = 32
MOST_TRACKED = 1_000_000
LANES = 64
#: Largest miscount of a frequent-items sketch, as a multiple of total / tracked items.
SKETCH_ERROR = 3.5


def candidate_terms(docs: DataFrame, term_array: str, tracked: int) -> list:
    """Terms, with upper bounds of their counts, that one frequent-items sketch keeps.

    Tasks send sketches of a fixed size, never their terms; sketches meet in ``LANES`` groups first.
    """
    each = docs.select(F.explode(term_array).alias("term"), F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("lane"))
    sketches = each.groupBy("lane").agg(F.expr(f"approx_top_k_accumulate(term, {tracked})").alias("sketch"))
    whole = sketches.agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    found = whole.select(F.expr(f"approx_top_k_estimate(sketch, {tracked})").alias("items")).first()
    return found["items"] if found and found["items"] else []


def vocabulary(docs: DataFrame, doc: str, k: int, term_array: str = "terms", tracked: int | None = None) -> DataFrame:
    """(term, total, df) of the ``k`` most frequent terms, exactly, without shuffling all terms.

    A sketch names candidates; only these are counted. A term it does not name occurs at most
    ``SKETCH_ERROR`` * n / tracked times, and no more often than what the candidates leave of
    all n occurrences. If the k-th candidate occurs more often, the result is proven; else a
    sketch four times as large is asked. Beyond ``MOST_TRACKED`` all terms are grouped.
    """
    n = docs.agg(F.sum(F.size(term_array)).alias("n")).first()["n"] or 0
    spark = docs.sparkSession
    tracked = min(tracked or max(1024, TRACKED_PER_TERM * k), MOST_TRACKED)
    while n:
        items = candidate_terms(docs, term_array, tracked)
        # At most ``tracked`` terms, which is what bounds the broadcast.
        names = F.broadcast(spark.createDataFrame([(r["item"],) for r in items], "term string"))
        kept = docs.select(doc, F.sort_array(term_array).alias(term_array))
        counted = cut(term_statistics(term_counts(kept, doc, term_array).join(names, "term")), "candidates")
        sums = counted.agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("terms")).first()
        least = counted.orderBy(F.desc("total"), "term").limit(k).agg(F.min("total").alias("t")).first()["t"]
        unseen = SKETCH_ERROR * n / tracked
        if len(items) >= tracked:  # some that the sketch holds were cut off
            unseen = max(unseen, min(r["count"] for r in items))
        if sums["n"] == n or (sums["terms"] >= k and least > min(unseen, n - sums["n"])):
            return vocabulary_topk(counted, k)
        if tracked == MOST_TRACKED:
            break
        tracked = min(4 * tracked, MOST_TRACKED)
    return vocabulary_topk(term_statistics(term_counts(docs, doc, term_array)), k)


#: Most words, or terms, that a filter inside a row may list; beyond that all terms are grouped.
MOST_LISTED = 20_000


def pairs_of(words: Column) -> tuple[Column, Column]:
    """First and second words of all pairs of neighbours."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n)


def known_terms(words: Column, names: list[str]) -> Column:
    """Of all words and pairs in a row those among ``names``, with repetitions."""
    single, double = [t for t in names if " " not in t], [t for t in names if " " in t]
    kept = F.filter(words, lambda w: w.isin(single)) if single else F.array().cast("array<string>")
    if not double:
        return kept
    firsts, seconds = ({t.split(" ")[i] for t in double} for i in (0, 1))
    both = lambda a, b: F.when(a.isin(firsts) & b.isin(seconds), F.concat_ws(" ", a, b))
    return F.concat(kept, F.filter(F.zip_with(*pairs_of(words), both), lambda t: t.isin(double)))


def word_vocabulary(docs: DataFrame, doc: str, k: int, bigrams: bool = True, words_array: str = "_words") -> DataFrame:
    """(term, total, df) of the ``k`` most frequent words and pairs of neighbours, exactly.

    A pair occurs no more often than either of its words, and the k most frequent words are k
    terms already. So only words as frequent as the k-th, and pairs of them, can be among the best;
    rarer pairs are never made. Three passes: words, pairs of frequent words, documents of the terms found.
    Words have no blank. ``explode_outer``: the filter that ``explode`` adds would tokenize twice.
    """
    spark = docs.sparkSession
    at = F.col(words_array)
    each = docs.select(F.explode_outer(at).alias("term")).filter(F.col("term").isNotNull())
    counts = cut(each.groupBy("term").agg(F.count(F.lit(1)).alias("total")), "words")
    best = F.desc("total"), "term"
    least = counts.orderBy(*best).limit(k).agg(F.min("total").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not least["n"]:
        return vocabulary_topk(counts.withColumn("df", F.col("total")), k)
    frequent = counts.filter(F.col("total") >= (least["t"] if least["n"] == k else 0))
    if bigrams:
        listed = [r["term"] for r in frequent.limit(MOST_LISTED + 1).collect()]
        if max(len(listed), k) > MOST_LISTED:  # that many as rare as the k-th
            return vocabulary_topk(term_statistics(term_counts(docs.select(doc, terms(at).alias("terms")), doc)), k)
        first, second = pairs_of(at)
        pair = docs.select(F.arrays_zip(first.alias("a"), second.alias("b")).alias("_pairs")).select(F.explode_outer("_pairs").alias("p"))
        pair = pair.select("p.a", "p.b").filter(F.col("a").isin(listed) & F.col("b").isin(listed))
        pair = pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("total"))
        frequent = frequent.unionByName(pair.select(F.concat_ws(" ", "a", "b").alias("term"), "total"))
    elif k > MOST_LISTED:
        return vocabulary_topk(term_statistics(term_counts(docs.select(doc, at.alias("terms")), doc)), k)
    top = frequent.orderBy(*best).limit(k).collect()
    held = docs.select(F.array_distinct(known_terms(at, [r["term"] for r in top])).alias("_terms"))
    held = held.select(F.explode_outer("_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    totals = spark.createDataFrame([(r["term"], r["total"]) for r in top], "term string, total bigint")
    return vocabulary_topk(cut(held.join(F.broadcast(totals), "term").select("term", "total", "df"), "vocabulary"), k)


def idf(n_docs: Column, df: str | Column = "df") -> Column:
    """Smoothed: ln((1 + N) / (1 + df)) + 1."""
    return F.ln((F.lit(1.0) + n_docs) / (F.lit(1.0) + col(df))) + F.lit(1.0)


def idf_table(vocabulary: DataFrame, docs: DataFrame) -> DataFrame:
    """Vocabulary with ``idf``; ``docs`` is the corpus, one row per document."""
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return vocabulary.withColumn("idf", idf(n))


def tfidf(
    df: DataFrame, doc: str, text: str, k: int, bigrams: bool = True, sublinear: bool = True,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """(doc, term, weight): weighted terms, scaled so that a document has length 1.

    The vocabulary has at most ``k`` rows and is broadcast: terms outside it drop out inside
    their row, before anything is sorted or shuffled. The only shuffle over documents then brings the kept
    terms of a document together, and its length is taken inside that row.
    """
    tokens = words(text)
    if stop_words:
        tokens = remove_stop_words(tokens, stop_words)
    tokenized = df.select(doc, tokens.alias("_words"))
    known = idf_table(word_vocabulary(tokenized, doc, k, bigrams), df)
    if k <= MOST_LISTED:
        names = [r["term"] for r in known.select("term").collect()]
        kept = tokenized.select(doc, known_terms(F.col("_words"), names).alias("terms"))
    else:
        kept = tokenized.select(doc, terms(F.col("_words"), bigrams).alias("terms"))
    counts = term_counts(kept, doc)
    tf = F.lit(1.0) + F.ln("tf") if sublinear else F.col("tf").cast("double")
    weighted = counts.join(F.broadcast(known.select("term", "idf")), "term").select(
        doc, F.struct("term", (tf * F.col("idf")).alias("w")).alias("e")
    )
    rows = weighted.groupBy(doc).agg(F.array_sort(F.collect_list("e")).alias("es"))
    length = F.sqrt(F.aggregate("es", F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"]))
    return (
        rows.withColumn("_len", length)
        .select(doc, "_len", F.explode("es").alias("e"))
        .select(doc, F.col("e.term").alias("term"), (F.col("e.w") / F.col("_len")).alias("weight"))
    )


# --- categories ------------------------------------------------------------------------

def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(category, code): distinct values in sorted order, from 0.

    Distinct values are dealt out by range and sorted in their partition; a value's code is
    its place there plus what the partitions before it hold. Written once, so that both
    uses see the same partitions; Spark then knows its size and broadcasts small ones.
    """
    values = df.select(F.col(column).alias("category")).filter(F.col("category").isNotNull()).distinct()
    at = F.monotonically_increasing_id()
    placed = cut(
        values.repartitionByRange("category").sortWithinPartitions("category")
        .select("category", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")),
        "codes",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    starts = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select("category", (F.col("_place") + F.col("_start")).alias("code"))


def ordinal_encode(df: DataFrame, fitted: dict[str, DataFrame]) -> DataFrame:
    """Add ``<column>_code`` per fitted column; values not seen in fitting get -1."""
    for column, codes in fitted.items():
        renamed = codes.select(F.col("category").alias(column), F.col("code").alias(f"{column}_code"))
        df = df.join(renamed, column, "left").withColumn(
            f"{column}_code", F.coalesce(f"{column}_code", F.lit(-1).cast("bigint"))
        )
    return df


def label_decode(df: DataFrame, codes: DataFrame, code: str, into: str) -> DataFrame:
    """Inverse of the encoding."""
    back = codes.select(F.col("code").alias(code), F.col("category").alias(into))
    return df.join(back, code, "left")
