"""The dense index against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexivault.operators import ivf
from lexivault.operators.ivf import Codes, IvfIndex, bounded
from lexivault.sources import corpus

from .test_batch import brute_nearest


def table(spark, rows, first="chunk_id"):
    return spark.createDataFrame(rows, f"{first} long, embedding array<double>")


def got(found):
    return sorted((x.query, x.id, round(x.distance, 9), x.rank) for x in found.collect())


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 12)) * 4
    return [(k, (centres[r.integers(0, 30)] + r.normal(size=12)).tolist()) for k in range(1500)]


def test_exact(spark, clustered, monkeypatch):
    """Several blocks to a cell and packs to a query block; a copy that makes up a third of the rows; ties."""
    monkeypatch.setattr(ivf, "BLOCK", 50)
    rows = clustered + [(2000 + k, clustered[0][1]) for k in range(700)]
    index = IvfIndex.build(table(spark, rows).repartition(4))
    asked = [(q, x) for q, x in rows[::40]] + [(-1, [0.0] * 12), (-2, [50.0] * 12)]
    assert got(index.search(table(spark, asked, "query"), 8, exact=True)) == brute_nearest(rows, asked, 8)
    assert index.blocks.agg({"n": "sum"}).first()[0] == len(rows)


def test_recall(spark, clustered):
    """The part of the true neighbours that few cells give, and what it costs."""
    index = IvfIndex.build(table(spark, clustered))
    asked = clustered[::10]
    opened: list = []
    found = {(x.query, x.id) for x in index.search(table(spark, asked, "query"), 10, opened=opened).collect()}
    true = {(q, i) for q, i, _, _ in brute_nearest(clustered, asked, 10)}
    assert len(found & true) >= 0.9 * len(true)
    assert opened[0].count() <= 0.3 * len(index.centroids) * len(asked)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_tables(spark, sf):
    vectors = corpus.vectors(spark, f"/root/testdata/{sf}")
    rows = [(r.chunk_id, [float(v) for v in r.embedding]) for r in vectors.collect()]
    index = IvfIndex.build(vectors)
    asked = [r for r in rows if r[0] % 100 == 0]
    found = {(x.query, x.id) for x in index.search(table(spark, asked, "query"), 10).collect()}
    true = {(q, i) for q, i, _, _ in brute_nearest(rows, asked, 10)}
    assert len(found & true) >= 0.9 * len(true), len(found & true) / len(true)


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [float("nan"), 0.0]), (5, [None, 0.0]), (None, [1.0, 1.0]), (6, [1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 0.0])]
    index = IvfIndex.build(table(spark, rows))
    asked = table(spark, [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (None, [1.0, 0.0])], "query")
    for exact in (False, True):
        assert sorted((x.query, x.rank, x.id, x.distance) for x in index.search(asked, 9, exact=exact).collect()) == [(1, 1, 1, 0.0), (1, 2, 7, 0.0), (1, 3, 7, 0.0), (1, 4, 8, 1.0)]
    none = IvfIndex.build(table(spark, rows).limit(0))
    assert none.search(asked, 3).collect() == []
    assert index.search(asked.limit(0), 3, exact=True).collect() == []


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 1 << 30), st.integers(1, 12), st.sampled_from([1e-6, 1.0, 1e6]), st.integers(1, 5))
def test_bounds(seed, n, size, k):
    """Codes' bounds hold, and what is left out isn't among the nearest."""
    r = np.random.default_rng(seed)
    x, q = r.normal(size=(n, 5)) * size, r.normal(size=(3, 5)) * size
    x[: n // 2] = x[0]
    codes = Codes.of(x)
    for j, some, low, high in bounded(codes, q, k):
        true = np.sqrt(((x - q[j]) ** 2).sum(axis=1))
        assert (low <= true[some]).all() and (true[some] <= high).all()
        assert set(np.argsort(true, kind="stable")[:k][true[np.argsort(true, kind="stable")[:k]] < np.inf]) <= set(some) or np.sort(true[some])[: k].tolist() == np.sort(true)[:k].tolist()


def test_searcher(spark, clustered):
    """A searcher's dense pool by the index holds nearly all of the exact one, at the same distances."""
    from lexivault.plans.search import Filters, Searcher

    vectors = table(spark, clustered)
    chunks = vectors.select(vectors.chunk_id.alias("id"))
    plain = Searcher(chunks, vectors, lambda _: clustered[7][1])
    fast = Searcher(chunks, vectors, lambda _: clustered[7][1], near=IvfIndex.build(vectors))
    a, b = ({r.id: round(r.distance, 9) for r in s.dense_pool("x", 20, Filters()).collect()} for s in (plain, fast))
    assert len(b) == 20 and len(a.items() & b.items()) >= 18
