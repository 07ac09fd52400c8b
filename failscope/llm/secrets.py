"""Secret scans with an incremental ledger of content-addressed blobs.

A *path* (document) has a text; the text's SHA-256 names a *blob*. Each blob is scanned at
most once by each version of each rule, whatever the number of paths or scans. A row of
the ledger says, for one blob, which rule versions have seen it and what they found. One
scan

1. addresses every path's text,
2. takes one path for each blob that some rule version has not seen yet,
3. scans just these texts, each with its unseen rule versions only,
4. appends to the ledger, in one write that counts once it has ended,
5. joins the findings of the ledger back to all paths.

Changing a rule means giving it a new version: only that rule then runs again. Old rows of
the ledger stay, so a blob that returns years later costs nothing.

Spans of all matches come from built-in functions: ``split`` gives the text between the
matches and ``regexp_extract_all`` the matches; running lengths are the positions, in code
points, end exclusive.

Cases: a null text is the empty blob; an empty ledger folder or table is fine; repeated
rows give a result row each. Extra columns play no part.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    #: Group whose length counts, and the least length; shorter matches are dropped.
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The rules, in the order in which kinds are listed.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: Matches whose positions are summed at once.
BLOCK = 64
BASE = ("assign", "access", "hex")
LEDGER = "blob binary, rules array<string>, found array<struct<start:int,ord:int,stop:int,kind:string>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not for each element of a loop in it."""
    return F.transform(F.array(value), body)[0]


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """All matches of a rule as an array of (start, ord, stop, kind).

    Positions are running lengths. They are summed block by block, as appending to one long
    array copies it for each match.
    """
    kind = F.lit(rule.kind).alias("kind")
    gaps = F.split(text, rule.pattern, -1)
    full = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.arrays_zip(
        F.transform(F.slice(gaps, F.lit(1), F.size(full)), F.length).alias("gap"),
        F.transform(full, F.length).alias("len"),
        F.transform(part, F.length).alias("val"),
    )
    none = F.array().cast("array<struct<start:int,ord:int,stop:int,kind:string>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        stop = start + x["len"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), stop.alias("stop"), kind)
        out = F.when(x["val"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(stop.alias("at"), out.alias("out"))

    def block(steps, first):
        return F.slice(steps, first, F.lit(BLOCK))

    def blocks(steps):
        firsts = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(BLOCK))
        sums = F.transform(firsts, lambda b: F.aggregate(block(steps, b), F.lit(0), lambda n, x: n + x["gap"] + x["len"]))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))

        def of_block(at):
            def spans(first, i):
                zero = F.struct(F.get(at, i).alias("at"), none.alias("out"))
                return F.aggregate(block(steps, first), zero, step, lambda acc: acc["out"])

            return F.flatten(F.transform(firsts, spans))

        return let(before, of_block)

    return F.when(text.rlike(rule.pattern), let(steps, blocks)).otherwise(none)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per blob: rule versions that have seen it, and all it holds."""
    return (
        spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)
        .groupBy("blob")
        .agg(
            F.array_distinct(F.flatten(F.collect_set("rules"))).alias("rules"),
            F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"),
        )
    )


def new_ledger(spark: SparkSession, ledger: str) -> None:
    """An empty ledger, so that its first scan reads a table as all others do."""
    spark.createDataFrame([], LEDGER).coalesce(1).write.mode("append").parquet(f"{ledger}/start")


def scan(docs: DataFrame, ledger: str, batch: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger has not seen and append it as ``batch``.

    Writing a batch again replaces it, so a run that died can simply be repeated.
    """
    spark = docs.sparkSession
    wanted = F.array(*[F.lit(r.name) for r in rules])
    paths = docs.select(F.col("doc_id").alias("path"), blob_of(F.col("text")).alias("blob"))
    todo = (
        paths.groupBy("blob").agg(F.min("path").alias("path"))
        .join(read_ledger(spark, ledger).select("blob", "rules"), "blob", "left")
        .select("path", "blob", F.array_except(wanted, F.coalesce("rules", F.array().cast("array<string>"))).alias("todo"))
        .filter(F.size("todo") > 0)
    )
    texts = docs.select(
        F.col("doc_id").alias("_path"), blob_of(F.col("text")).alias("_blob"), F.coalesce("text", F.lit("")).alias("_text")
    )
    seen = texts.join(todo, F.col("_path").eqNullSafe(F.col("path")) & (F.col("_blob") == F.col("blob")))
    none = F.array().cast("array<struct<start:int,ord:int,stop:int,kind:string>>")
    found = [
        F.when(F.array_contains("todo", r.name), spans_of(F.col("_text"), r, i)).otherwise(none)
        for i, r in enumerate(rules)
    ]
    seen.select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("found")).write.mode("overwrite").parquet(
        f"{ledger}/{batch}"
    )


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What the ledger has on every path: doc_id and its spans in order of start and kind."""
    spark = docs.sparkSession
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    # Written, as adaptive execution splits a hot blob only between two plain tables.
    hits = cut(
        read_ledger(spark, ledger).filter(F.size("found") > 0)
        .select(F.col("blob").alias("_blob"), F.array_sort(F.filter("found", lambda x: F.array_contains(kinds, x["kind"]))).alias("found")),
        "hits",
    )
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("_blob"))
    return paths.join(hits, "_blob", "left").select(
        "doc_id", F.coalesce("found", F.array().cast(hits.schema["found"].dataType)).alias("found")
    )


def scan_all(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None, batch: str = "first") -> DataFrame:
    """Scan into a ledger (a new one, if none is named) and return all paths' findings."""
    if ledger is None:
        ledger = shared_dir(docs.sparkSession, "ledger")
        new_ledger(docs.sparkSession, ledger)
    scan(docs, ledger, batch, rules)
    return findings(docs, ledger, rules)


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda x: reduce(lambda a, b: a | b, [x["kind"] == k for k in kinds]))
