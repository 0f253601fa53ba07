"""Steps whose cost must grow with the input alone: joins on common terms, bags of long answers, chains told in order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorewright.operators import retrieval
from lorewright.plans import iterate


@pytest.fixture
def docs(spark):
    rows = [(1, "the cat and the dog"), (1, "cat"), (2, "the bird"), (3, ""), (4, None), (5, "the the dog dog dog")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def texts_moved(df):
    """Exchanges of a plan, by what they deal out by."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_terms_are_counted_where_their_document_is(spark, docs):
    asks = spark.createDataFrame([(1, "the dog"), (2, "cat cat"), (3, "none")], "ask long, text string")
    for df in (retrieval.heaviest(docs, 2), retrieval.shared(docs, asks, 2), retrieval.answers(docs, asks, 2)):
        assert not [x for x in texts_moved(df) if "term" in x.split("hashpartitioning(")[1].split(")")[0]]


@pytest.mark.parametrize("words", [2_000_000, 0])
def test_results_do_not_hang_on_how_terms_meet(spark, docs, monkeypatch, words):
    monkeypatch.setattr(retrieval, "WORDS", words)
    asks = spark.createDataFrame([(1, "the dog"), (2, "cat cat"), (3, "none")], "ask long, text string")
    found = lambda df: sorted(tuple(r) for r in df.collect())
    assert found(retrieval.shared(docs, asks, 2).select("ask", "doc_id", "shared", "rank")) == [(1, 1, 2, 1), (1, 5, 2, 2), (2, 1, 1, 1)]
    assert found(retrieval.answers(docs, asks, 2).select("ask", "doc_id", "rank")) == [(1, 1, 2), (1, 5, 1), (2, 1, 1)]
    assert [r[:2] for r in found(retrieval.heaviest(docs, 1).select("doc_id", "term"))] == [(1, "cat"), (2, "bird"), (5, "dog")]


def test_bags_of_long_answers(spark):
    df = spark.createDataFrame([("a a b", "a b b c"), ("", "a"), (None, "a"), (" ".join(f"w{k}" for k in range(20_000)), " ".join(f"w{k}" for k in range(0, 20_000, 2)))], "a string, b string")
    got = [r[0] for r in df.select(retrieval.overlap_f1(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([4 / 7, 0.0, 0.0, 2 / 3])


def test_chains_told_in_order_need_one_round(spark, monkeypatch):
    chains = spark.range(0, 3000, 1, 1).where("id % 30 <> 29").select(F.concat(F.lit("n"), F.lpad("id", 5, "0")).alias("u"), F.concat(F.lit("n"), F.lpad(F.col("id") + 1, 5, "0")).alias("v"))
    rounds, settle = [], iterate.settle
    monkeypatch.setattr(iterate, "settle", lambda df: rounds.append(1) or settle(df))
    got = {r.node: r.root for r in iterate.components(chains).collect()}
    assert got == {f"n{k:05}": f"n{k - k % 30:05}" for k in range(3000)} and len(rounds) == 2
    mixed = chains.repartition(7, F.rand(3)).union(chains.limit(1).select(F.lit("n00000"), F.lit("n02999")))
    assert {r.root for r in iterate.components(mixed).where("node in ('n02999', 'n02971')").collect()} == {"n00000"}
    longs = spark.range(100).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in iterate.components(longs).collect()} == {0}
