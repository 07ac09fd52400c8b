"""Corpus queries against their SQL twins, and the pipeline stage by stage."""

import glob
import os

import pytest

import corpus_pipeline
from check import rows_of
from failscope.llm import decontaminate, near_dedup
from failscope.llm.oracle import ORACLES
from failscope.llm.queries import QUERIES
from test_corpus_ops import brute_components, brute_hits, docs, none, texts  # noqa: F401

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(data_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query(spark, data_dir, con, key):
    df = QUERIES[key](spark, data_dir)
    cur = con.execute(ORACLES[key])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, data_dir, key):
    source = "pages" if key.startswith("op3") else "documents"
    n = spark.read.parquet(f"{data_dir}/{source}.parquet").count()
    got = QUERIES[key](spark, data_dir).count()
    assert got > 0 if key.startswith("op5") else got == n


def test_pages_keep_their_article(spark, data_dir):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect()}
    for r in QUERIES["op3_html_text"](spark, data_dir).collect():
        body = re.split(r"</article>|<footer>", pages[r["page_id"]].split("<article>", 1)[1])[0]
        body = html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)\b[^>]*>", " ", body)))
        assert r["text"] == " ".join(body.split()) and r["n_chars"] == len(r["text"])


def test_stages(spark, data_dir, docs, texts):  # noqa: F811
    """Each stage on odd rows: same columns, and the rows that brute force keeps."""
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    known = stages["language_id"](spark, docs, data_dir)
    assert known.columns == docs.columns
    letters = {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in known.collect()} == letters
    single = stages["near_dedup"](spark, docs, data_dir)
    assert single.columns == docs.columns
    parts = brute_components(texts, near_dedup.WORDS)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in parts.items() if c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    leak = docs.unionByName(spark.createDataFrame([(900, "Before. " + items[3][1] + " After", "en", "s1", 0, "x", 1)], docs.schema))
    pure = stages["benchmark_decontamination"](spark, leak, data_dir)
    assert pure.columns == docs.columns
    assert {r["doc_id"] for r in pure.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}
    mixed = stages["mixing"](spark, docs, data_dir)
    assert mixed.columns == docs.columns and 0 < mixed.count() < len(texts)
    assert stages["sharding"](spark, docs, data_dir).count() == len(texts)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data_dir).count() == 0, name


def test_run_keeps_only_what_stages_keep(spark, data_dir):
    rows = corpus_pipeline.run(spark, data_dir).collect()
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    assert 0 < len(rows) == len({r["doc_id"] for r in rows})
    assert all(source[r["doc_id"]] == r["text"] and not brute_hits(r["text"], items)[1] for r in rows)
    kept = brute_components([r["text"] for r in rows], near_dedup.WORDS)
    assert all(i == c for i, (_, c) in kept.items())
    assert decontaminate.WINDOW == 10
