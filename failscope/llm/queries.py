"""One query per corpus operator, over whole tables with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversations, decontaminate, fingerprints, html_extract, langid, line_dedup, merkle, mixing, near_dedup, secrets, sharding,
    substring_dedup, topk,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_all(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(secrets.of_kinds(F.col("found"), kind)).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.joined(secrets.of_kinds(F.col("found"), *secrets.BASE)).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("found")).alias("spans"),
    )


@query
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *sharding.OWN)


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), k=4)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    held_out = F.coalesce(langid.remainder() == 0, F.lit(True))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages, a row per stretch with one keeper; documents without one have no row."""
    rows = substring_dedup.stretches(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "stop", "n_chunks", "keeper", "dropped")


@query
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extract.extract(table(spark, sf_dir, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.probabilities(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"),
        "n_tokens", "probability", "kept",
    )


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))
