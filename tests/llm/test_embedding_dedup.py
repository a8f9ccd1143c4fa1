from __future__ import annotations

import math

import numpy as np
import pytest

from lexivault.llm import embedding_dedup as E


def brute(rows, least=0.98):
    """Links and components of (id, vector, label) rows, pair by pair."""
    ok = [k for k, (i, v, y) in enumerate(rows) if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    root = {i: i for i, _, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(rows[a][0]), find(rows[b][0])
                    root[max(p, q)] = min(p, q)
    return sorted((repr(i), n, repr(None if i is None else find(i))) for (i, _, _), n in zip(rows, links))


def got(df):
    return sorted((repr(r.vec_id), r.n_links, repr(r.component_id)) for r in df.collect())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [1.0, 0.0, 0.0], 2), (4, [2.0, 0.0, 0.0], 1), (5, [1.0, 0.0, 0.0], 1), (5, [1.0, 0.0, 0.0], 1),
        (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [nan, 0.0, 1.0], 1), (9, [inf, 0.0, 0.0], 1), (10, [1.0, None, 0.0], 1), (11, [1.0, 0.0, 0.0], None), (12, [], 1),
        (13, [1.0, 0.0], 1), (14, [1.0, 0.001], 1), (None, [1.0, 0.0, 0.0], 1), (15, [3e38, 0.0, 0.0], 1), (16, [1e-38, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, rep string, n int")
    exact = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], y) for i, v, y in rows]
    assert got(E.link_vectors(df)) == brute(exact)
    assert E.link_vectors(df.limit(0)).collect() == []
    kept = {r.vec_id for r in E.link_vectors(df).collect() if r.kept}
    assert kept == {1, 3, 6, 7, 8, 9, 10, 11, 12, 13}


def test_recall_on_near_copies(spark):
    """Groups of near copies of several sizes, among many other vectors, with leaves small enough to split them."""
    r = np.random.default_rng(2)
    rows = []
    for group in range(60):
        centre = r.standard_normal(32)
        for _ in range(int(r.integers(1, 12))):
            rows.append((len(rows), (centre + r.standard_normal(32) * 0.06).astype(np.float32).tolist(), int(group % 2)))
    for _ in range(800):
        rows.append((len(rows), r.standard_normal(32).astype(np.float32).tolist(), int(r.integers(0, 2))))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    mine = got(E.link_vectors(df))
    true = brute(rows)
    found, there = sum(n for _, n, _ in mine), sum(n for _, n, _ in true)
    assert there > 300 and found >= 0.99 * there
    assert all(a[1] <= b[1] for a, b in zip(mine, true))  # and no link that isn't one


def test_a_pair_in_several_leaves_counts_once():
    x = np.array([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]])
    link, counted = E.compare_block(x, None, 0.98, [np.array([1, 9]), np.array([1, 9]), np.array([9])], 9)
    assert link[0, 1] and not counted.any()
    link, counted = E.compare_block(x, None, 0.98, [np.array([1, 9]), np.array([1, 9]), np.array([9])], 1)
    assert counted[0, 1] and counted.sum() == 2
    link, _ = E.compare_block(x[:1], x[1:], 0.98, [np.array([9])] * 3, 9)
    assert link[0, 1] and link[1, 0] and not link[1, 2]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, sf):
    from tests.oracle import compare

    n, m, different = compare(spark, E.op5_embedding_dedup, E.ORACLE, f"/root/testdata/{sf}")
    assert n == m > 0 and not different


def near_copies(r, n, dim, labels=1):
    """Vectors of which many are near another, at all cosines around the bound."""
    x = r.standard_normal((n, dim))
    at = r.permutation(n)[: n // 3]
    x[at] = x[(at + 1) % n] + r.standard_normal((len(at), dim)) * r.uniform(0.02, 0.3, (len(at), 1))
    return [(k, x[k].astype(np.float32).tolist(), int(k % labels)) for k in range(n)]


def test_forest_at_production_parameters(spark):
    """Thousands of vectors of a label, trees of several levels: links found against all there are."""
    rows = near_copies(np.random.default_rng(4), 4000, 64)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    mine = {r.vec_id: r for r in E.link_vectors(df).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.98
    np.fill_diagonal(link, False)
    true = link.sum(axis=1)
    found = np.array([mine[k].n_links for k in range(len(rows))])
    assert true.sum() > 600 and (found <= true).all() and found.sum() >= 0.98 * true.sum()
    spill = E.SPILL * 0.2 / 8
    reached = E.leaves_of(x, 0, 1, spill)
    assert len(reached) > 50 and max(len(r) for _, r in reached) <= E.LEAF
    assert sum(len(r) for _, r in reached) < 3 * len(x)  # the spill copies few


def test_large_nodes_are_split_by_rounds(spark, monkeypatch):
    """Nodes too large for a task, a hot one among them, and one of vectors too close to be split."""
    monkeypatch.setattr(E, "TASK_BYTES", 100 * 16 * 8)
    monkeypatch.setattr(E, "BLOCK", 64)
    r = np.random.default_rng(6)
    rows = near_copies(r, 900, 16, 2)
    centre = r.standard_normal(16)
    rows += [(1000 + k, (centre + r.standard_normal(16) * 0.001).astype(np.float32).tolist(), 7) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    mine, true = got(E.link_vectors(df)), brute(rows)
    assert all(a[1] <= b[1] for a, b in zip(mine, true))
    assert sum(a[1] for a in mine) >= 0.98 * sum(b[1] for b in true)
    assert [a for a in mine if int(a[0]) >= 1000] == [b for b in true if int(b[0]) >= 1000]
