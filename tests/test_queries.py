"""Every query against its SQL twin on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as contract
from check import rows_of
from failscope.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")

# Minutes each; tests/test_learning.py has small forms of them.
SLOW = {"train_gradient_boosting", "train_structured_baseline", "vote_ensemble", "tune_grid"}


@pytest.fixture(scope="module")
def con(data_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("key", sorted(set(QUERIES) - SLOW))
def test_query(spark, data_dir, con, key):
    df = QUERIES[key](spark, data_dir)
    cur = con.execute(contract.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() == 1000


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) <= set(contract.oracle_sql()) | {"remove_stop_words", "tfidf_baseline"}
