from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexivault.llm import vector_codes as M

from ..oracle import compare


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    n, m, different = compare(spark, M.op11_vector_codes, M.ORACLE, f"/root/testdata/{sf}")
    assert n == m > 0 and not different, different


def plain_nearest(x, entries):
    found = []
    for row in x.tolist():
        d = [sum((a - b) ** 2 for a, b in zip(row, e)) for e in entries.tolist()]
        found.append((d.index(min(d)), min(d)))
    return found


@settings(deadline=None, max_examples=80)
@given(st.integers(0, 1 << 30), st.integers(1, 30), st.integers(1, 4), st.sampled_from([2, 9, 5000, 1 << 33, 1 << 50]))
def test_tree(seed, n, dim, span):
    """Against all distances, with many ties and equal entries, and beyond what 64 bits hold."""
    r = np.random.default_rng(seed)
    entries, x = r.integers(-span, span, (n, dim)), r.integers(-span, span, (40, dim))
    x[:n] = entries[:40]
    index, best = M.Tree(entries).nearest(x)
    assert list(zip(index.tolist(), map(int, best))) == plain_nearest(x, entries)


def test_tree_skips():
    """Entries in clusters: most distances are never computed."""
    r = np.random.default_rng(1)
    centres = r.integers(-(10**6), 10**6, (16, 8))
    x = centres[r.integers(0, 16, 4000)] + r.integers(-50, 50, (4000, 8))
    tree = M.Tree(centres)
    index, _ = tree.nearest(x)
    assert index.tolist() == [k for k, _ in plain_nearest(x, centres)]
    assert tree.visited < 0.5 * 16 * len(x)


@given(st.lists(st.integers(0, (1 << 61) - 1), min_size=1, max_size=20))
def test_roots(values):
    for kind in (np.int64, object):
        down, up = M.root(np.array(values, dtype=kind)), M.root_up(np.array(values, dtype=kind))
        assert [int(v) for v in down] == [math.isqrt(v) for v in values]
        assert all(int(u) == d + (d * d < v) for u, d, v in zip(up, map(int, down), values))


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """The contract in plain Python; ``rows``: (id, label, whole numbers), in the order of their ids."""
    length = len(rows[0][2]) // parts
    books = [[list(v[p * length : (p + 1) * length]) for _, _, v in rows[:entries]] for p in range(parts)]

    def assign():
        return [[plain_nearest(np.array([v[p * length : (p + 1) * length]]), np.array(books[p]))[0] for p in range(parts)] for _, _, v in rows]

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * length : (p + 1) * length] for (_, _, v), a in zip(rows, now) if a[p][0] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = [(i, label, "".join(f"{e:02x}" for e, _ in a), sum(d for _, d in a)) for (i, label, _), a in zip(rows, assign())]
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    return [(*o, sums[o[1]]) for o in out], books


def test_edges(spark):
    """Nulls in every column, unusable vectors, ties, repeats, clashing columns; a label with most rows."""
    r = np.random.default_rng(3)
    good = [(k, "hot" if k % 3 else None, [float(v) for v in r.normal(size=16)]) for k in range(60)]
    good += [(60, "x", good[5][2]), (60, "x", good[5][2]), (None, "y", good[6][2]), (61, "y", [0.0] * 16), (62, "", [-0.00001] * 16)]
    bad = [(1000, "x", None), (1001, "x", []), (1002, "x", [1.0] * 15), (1003, "x", [1.0] * 24), (1004, "hot", [float("nan")] + [1.0] * 15), (1005, "hot", [float("inf")] + [1.0] * 15), (-7, "hot", [None] + [1.0] * 15)]
    df = spark.createDataFrame([(*g, 1, "v") for g in good + bad], "vec_id long, label string, embedding array<double>, error int, code string").repartition(5)
    got = M.compress_vectors(df).collect()
    whole = [(i, label, [math.floor(4096 * x) for x in v]) for i, label, v in good]
    whole.sort(key=lambda g: (g[0] is None, g[0] or 0))
    expected, books = plain_codes(whole)
    assert sorted(repr(tuple(g)[:5]) for g in got) == sorted(map(repr, expected))
    made = np.array(books)
    assert {g.codebooks_sha256 for g in got} == {M.books_digest(made)}
    assert M.decode(got[0].code, made)[:2] == books[0][int(got[0].code[:2], 16)][:2]
    assert M.compress_vectors(df.limit(0)).collect() == []
    few = M.compress_vectors(df.where("vec_id < 3 and vec_id >= 0")).collect()
    assert len(few) == 3 and all(g.error == 0 for g in few)


def test_names_and_large(spark):
    rows = [(k, "a", [float((-1) ** k * k * 3000)] * 8) for k in range(20)]
    df = spark.createDataFrame(rows, "`an id` long, `the.label` string, `v``v` array<double>").withColumn("x", M.F.lit(1)).repartition(3)
    got = {r[0]: r for r in M.compress_vectors(df, "an id", "v`v", "the.label").collect()}
    expected, _ = plain_codes([(i, label, [int(4096 * x) for x in v]) for i, label, v in rows])
    assert [(i, got[i].code) for i in sorted(got)] == [(e[0], e[2]) for e in expected]
