"""Language ID: unigram pieces, with all segmentations of a word summed up.

A language gives each piece of a fixed public vocabulary a probability. The probability of
a word is the sum, over all ways to cut it into pieces, of the product of their
probabilities; a forward pass computes it without listing the cuts. A text's score for a
language is the product over its words; the language with the highest one wins, and the
reported score is its posterior under equal priors.

*Words* are maximal runs of letters, in lower case, begun with the vocabulary's word mark;
a run of more than ``UNIT`` characters is cut every ``UNIT`` (all of it still counts). A
letter that no piece covers is a piece of its own with a small probability that is the same
in every language.

*Training* is expectation-maximisation: forward and backward passes give expected piece
counts of the words of each language. Expected counts are summed in Spark; only
(language, piece) totals come to the driver, at most languages x vocabulary. The classifier
is fitted on a hash sample of about ``SAMPLE_DOCS`` whole documents per language (all, if
there are fewer); only documents with a language and crc32(doc_id) mod 5 other than 0 count.

Cases: a null text and one without a letter are "und" with score 0, and so is every text if
there was nothing to learn from. A null doc_id is held out. Ties go to the language that
sorts first. Repeated rows get a row each; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, slices, without

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_DOCS = 2_000
ROUNDS = 3
UNIT = 24
WORDS_AT_ONCE = 10_000
MARK = "▁"
UNKNOWN = 1e-7
SMOOTH = 0.05
UND = "und"
SPLIT = 5
MIN_SCORE = 0.5
BATCH_ROWS = 1000
UNITS_AT_ONCE = 10_000


class Pieces(NamedTuple):
    """The vocabulary by length: sorted hashes and the ids that go with them."""

    hashes: tuple
    ids: tuple
    size: int


class Model(NamedTuple):
    pieces: Pieces
    langs: tuple
    #: (pieces + 1, languages); the last row is the unknown letter.
    prob: np.ndarray


def load_vocabulary(path: str = VOCABULARY) -> list[str]:
    """Pieces that can occur in a word: letters in lower case, with or without the mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
    return sorted(p for p in names if p == MARK or ((core := p.removeprefix(MARK)).isalpha() and core == core.lower()))


def roll(h, codes):
    """Hash of a string and one more character."""
    return (h ^ codes) * np.uint64(0x9E3779B97F4A7C15) + (h >> np.uint64(29))


def codes_of(text: str):
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def index_pieces(vocabulary: list[str]) -> Pieces:
    by: dict[int, list[tuple[int, int]]] = {}
    for i, piece in enumerate(vocabulary):
        h = np.zeros(1, np.uint64)
        for c in codes_of(piece):
            h = roll(h, c)
        by.setdefault(len(piece), []).append((int(h[0]), i))
    most = max(by, default=0)
    rows = [sorted(by.get(n, [])) for n in range(1, most + 1)]
    return Pieces(
        tuple(np.array([r[0] for r in x], np.uint64) for x in rows), tuple(np.array([r[1] for r in x], np.int32) for x in rows),
        len(vocabulary),
    )


def lookup(pieces: Pieces, codes) -> list:
    """For each piece length, ids (units, starts) of the pieces that begin there, or -1."""
    found, h = [], np.zeros(codes.shape, np.uint64)
    for n, (known, ids) in enumerate(zip(pieces.hashes, pieces.ids, strict=True), 1):
        if n > codes.shape[1]:
            break
        h = roll(h[:, : codes.shape[1] - n + 1], codes[:, n - 1 :])
        got = np.full(h.shape, -1, np.int32)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            got = np.where(known[at] == h, ids[at], -1)
        if n == 1:
            got = np.where(got < 0, pieces.size, got)
        found.append(got)
    return found


def forward(found: list, length: int, prob):
    """Sums over the segmentations of every prefix: (units, length + 1, languages)."""
    a = np.zeros((len(found[0]), length + 1, prob.shape[1]))
    a[:, 0] = 1
    for end in range(1, length + 1):
        for n in range(1, min(end, len(found)) + 1):
            ids = found[n - 1][:, end - n]
            hit = np.flatnonzero(ids >= 0)
            a[hit, end] += a[hit, end - n] * prob[ids[hit]]
    return a


def units_of(words: pa.Array):
    """Marked words cut into units: all codes, and each unit's start, length and word."""
    marked = pc.binary_join_element_wise(pa.scalar(MARK), words, "")
    size = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = codes_of("".join(marked.to_pylist()))
    first = np.cumsum(size) - size
    parts = -(-size // UNIT)
    word = np.repeat(np.arange(len(size)), parts)
    inside = (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)) * UNIT
    return codes, first[word] + inside, np.minimum(UNIT, size[word] - inside), word


def by_length(words: pa.Array):
    """Groups of units with the same length: (length, codes matrix, word of each unit)."""
    codes, start, size, word = units_of(words)
    for length in np.unique(size):
        own = np.flatnonzero(size == length)
        for at in range(0, len(own), UNITS_AT_ONCE):
            part = own[at : at + UNITS_AT_ONCE]
            yield int(length), codes[start[part][:, None] + np.arange(length)], word[part]


def word_scores(model: Model, words: pa.Array):
    """Log probability of each word in each language."""
    out = np.zeros((len(words), len(model.langs)))
    for length, codes, word in by_length(words):
        total = forward(lookup(model.pieces, codes), length, model.prob)[:, length]
        np.add.at(out, word, np.log(np.maximum(total, 1e-300)))
    return out


def expected(pieces: Pieces, prob, words: pa.Array, weights):
    """Expected count of each piece in the words of one language."""
    counts = np.zeros(pieces.size + 1)
    for length, codes, word in by_length(words):
        found = lookup(pieces, codes)
        ahead = forward(found, length, prob)[:, :, 0]
        back = np.zeros_like(ahead)
        back[:, length] = 1
        for start in range(length - 1, -1, -1):
            for n in range(1, min(length - start, len(found)) + 1):
                ids = found[n - 1][:, start]
                hit = np.flatnonzero(ids >= 0)
                back[hit, start] += prob[ids[hit], 0] * back[hit, start + n]
        scale = weights[word] / np.maximum(ahead[:, length], 1e-300)
        for n, ids in enumerate(found, 1):
            for start in range(ids.shape[1]):
                hit = np.flatnonzero(ids[:, start] >= 0)
                own = ids[hit, start]
                share = ahead[hit, start] * prob[own, 0] * back[hit, start + n] * scale[hit]
                counts += np.bincount(own, share, len(counts))
    return counts


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, and for every word of every text its index and its text."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " ")
    lists = pc.split_pattern(plain, " ")
    flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), owner[full.to_numpy(zero_copy_only=False)]


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & (remainder() != 0))


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % SPLIT


def training_words(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(lang, word, n) over the sample."""
    known = learnable(docs)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return known.select("lang", F.lit("").alias("word"), F.lit(0).cast("bigint").alias("n")).limit(0)
    part = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, sample_docs / n)])
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            langs = batch.column(0)
            for lang in pc.unique(langs):
                words, at, _ = words_of(batch.column(1).filter(pc.equal(langs, lang)))
                n = np.bincount(at, minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()] * len(words), pa.string()), words.cast(pa.string()), pa.array(n, pa.int64())],
                    ["lang", "word", "n"],
                )

    counted = known.filter(draw < part[F.col("lang")]).select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together: words are short, and many at once are cheaper."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of every language that ``docs`` name."""
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = index_pieces(load_vocabulary(vocabulary))
    words = cut(training_words(docs, sample_docs), "language-words")
    langs = tuple(sorted(r["lang"] for r in words.select("lang").distinct().collect()))
    prob = np.full((pieces.size + 1, len(langs)), 1.0 / (pieces.size + 1))
    for _ in range(rounds if langs else 0):
        sent = spark.sparkContext.broadcast((pieces, langs, prob))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces, langs, prob = sent.value
            counts = np.zeros((pieces.size + 1, len(langs)))
            for batch in joined(batches, WORDS_AT_ONCE):
                for k, lang in enumerate(langs):
                    own = batch.filter(pc.equal(batch.column(0), lang))
                    if own.num_rows:
                        weights = own.column(2).to_numpy().astype(float)
                        counts[:, k] += expected(pieces, prob[:, k : k + 1], own.column(1), weights)
            i, k = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.array(counts[i, k], pa.float64())], ["piece", "k", "n"]
            )

        sums = words.mapInArrow(expect, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n"))
        counts = np.zeros_like(prob)
        for r in sums.collect():  # at most one row per piece and language
            counts[r["piece"], r["k"]] = round(r["n"], 6)
        sent.destroy()
        prob = (counts + SMOOTH) / (counts.sum(0) + SMOOTH * len(counts))
    prob[-1] = UNKNOWN
    return Model(pieces, langs, prob)


def classify(model: Model, texts: pa.Array) -> tuple[list, np.ndarray]:
    """Language and posterior of every text."""
    lang, score = [UND] * len(texts), np.zeros(len(texts))
    if not model.langs or not len(texts):
        return lang, score
    words, at, owner = words_of(texts)
    logs = word_scores(model, words)
    total = np.stack([np.bincount(owner, logs[at, k], len(texts)) for k in range(len(model.langs))], 1)
    best = total.argmax(1)
    posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    for i in np.unique(owner):
        lang[i], score[i] = model.langs[best[i]], posterior[i]
    return lang, score


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; only the text is looked at."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def guess(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            # A few rows at a time bound what the worker holds besides its batch.
            done = [classify(sent.value, part.slice(at, BATCH_ROWS).cast(pa.string())) for at in range(0, len(part), BATCH_ROWS)]
            got, p = [x for d in done for x in d[0]], np.concatenate([np.empty(0), *[d[1] for d in done]])
            yield pa.StructArray.from_arrays([pa.array(got, pa.string()), pa.array(p)], ["lang", "score"])

    docs = without(docs, lang, score, "_guess")
    return docs.withColumn("_guess", guess("text")).select(
        *docs.columns, F.col("_guess.lang").alias(lang), F.col("_guess.score").alias(score)
    )


def accepted(docs: DataFrame, model: Model, least: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text is in a known language, with all their columns."""
    return predict(docs, model, "_lang", "_score").filter((F.col("_lang") != UND) & (F.col("_score") >= least)).drop("_lang", "_score")
