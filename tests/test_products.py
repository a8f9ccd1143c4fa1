"""Whole texts as queries, by products of packs with blocks of queries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexivault.operators import lexical, products
from lexivault.operators.blocks import BlockIndex, top_batch
from lexivault.operators.products import packed, top_products
from lexivault.queries import QUERIES

KIND = "id long, name string, scope string, content string"


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of few frequent and many rare words, copies, empty ones, letters beyond ASCII, negative and far ids."""
    r = random.Random(3)
    rows = []
    for k in range(900):
        said = [f"w{min(int(r.expovariate(0.08)), 90)}" if r.random() < 0.8 else f"é{r.randrange(3000)}" for _ in range(r.choice([0, 1, 5, 40, 120]))]
        rows.append((k * 7 - 1500 if k % 40 else k * (1 << 45), "name" if k % 50 == 0 else None, None, " ".join(said)))
    rows += [(100_000 + k, None, None, rows[44][3]) for k in range(60)]
    return spark.createDataFrame(rows, KIND).cache()


def asked(rows, of):
    return rows.where(F.col("id") % of == 0).select(F.col("id").alias("query"), F.explode(F.split("content", " ")).alias("term"))


def found(df):
    return sorted((r.query, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize(("rows", "queries", "pairs", "ratio", "wide", "adds", "exact"), [(4096, 1024, 4_000_000, 400, 1024, 1 << 20, None), (100, 7, 1500, 400, 3, 500, None), (64, 16, 900, 0, 8, 100, None), (300, 40, 10**6, 10**9, 16, 50, None), (200, 30, 2000, 400, 1024, 1 << 20, 1e12)])
def test_as_by_blocks(spark, corpus, monkeypatch, rows, queries, pairs, ratio, wide, adds, exact):
    """The rows of ``top_batch``, with one or many packs, blocks, groups and parts, by products or additions alone, and in whole numbers
    where doubles don't hold them."""
    for name, value in dict(ROWS=rows, QUERIES=queries, PAIRS=pairs, RATIO=ratio, WIDE=wide, ADDS=adds, PARTS=3, PACKS=2, EXACT=exact or products.EXACT).items():
        monkeypatch.setattr(products, name, value)
    words = asked(corpus, 4).unionByName(spark.createDataFrame([(-1, "nothing"), (-2, "w0"), (-2, "w0"), (-2, None), (-3, "nothing"), (-3, "w1"), (None, "w1")], "query long, term string"))
    index = BlockIndex.of(lexical.postings(corpus), lexical.corpus_stats(corpus))
    packs = packed(corpus.repartition(3)).cache()
    assert packs.agg(F.sum("n")).first()[0] == corpus.count() and packs.where(F.col("n") > rows).isEmpty()
    got = found(top_products(packs, words, 10))
    assert got == found(top_batch(index, words, 10))
    assert not [r for r in got if r[0] == -1] and len([r for r in got if r[0] == -2]) == 10


def test_nothing(spark, corpus):
    none = spark.createDataFrame([], KIND)
    words = asked(corpus, 40)
    assert top_products(packed(none), words, 5).collect() == []
    assert top_products(packed(corpus), words.limit(0), 5).collect() == []
    empty = spark.createDataFrame([(1, None, None, None), (2, None, None, ""), (None, None, None, "w1")], KIND)
    assert top_products(packed(empty), words, 5).collect() == []


def test_no_posting_is_a_row(spark):
    """The registered query joins packs with blocks of queries; before, each query's words met the heads of all buckets and postings."""
    plan = QUERIES["search_bm25_batch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "arrays_zip" not in plan and "CoGroups" in plan
