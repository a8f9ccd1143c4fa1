from __future__ import annotations

import zlib

import numpy as np
import pytest

from lexivault.llm import quality_classifier as M

D = len(M.FEATURES)


def plain_scores(x, rows, labels, pooled=M.TOWARDS_POOLED, sphere=M.TOWARDS_SPHERE):
    """Scores of ``x`` by the definition, with determinants and inverses in place of factors; all in features' units."""
    x, rows = x / M.GRID, rows / M.GRID
    own = [rows[labels == c] for c in (0, 1)]
    scatter = [(o - o.mean(axis=0)).T @ (o - o.mean(axis=0)) for o in own]
    density = []
    for o, s in zip(own, scatter):
        cov = ((1 - pooled) * s + pooled * sum(scatter)) / ((1 - pooled) * len(o) + pooled * len(rows))
        cov = (1 - sphere) * cov + sphere * np.trace(cov) / D * np.eye(D) + M.LEAST_VARIANCE * np.eye(D)
        diff = x - o.mean(axis=0)
        density.append(np.log(len(o)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs.collect(), {r.doc_id: r.quality for r in labels.collect()}, {r.doc_id: r for r in M.op12_quality_classifier(spark, d).collect()}


def test_whole_table(scored):
    """Every row's score against the definition, learned from the labelled rows that aren't held out."""
    docs, labels, got = scored
    x = M.statistics([(r.text or "").encode() for r in docs])
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs])
    label = np.array([labels.get(r.doc_id, -1) for r in docs])
    learn = ~held & (label >= 0)
    expected = plain_scores(x, x[learn], label[learn])
    mine = np.array([got[r.doc_id].score for r in docs])
    assert len(got) == len(docs) and np.abs(mine - expected).max() < 1e-5
    assert [got[r.doc_id].held_out for r in docs] == held.tolist()
    assert [got[r.doc_id].predicted for r in docs] == (mine >= 0.3).astype(int).tolist()


def test_held_out(scored):
    docs, labels, got = scored
    pairs = [(labels[r.doc_id], got[r.doc_id].predicted) for r in docs if r.doc_id in labels and got[r.doc_id].held_out]
    good, bad = [p for y, p in pairs if y == 1], [p for y, p in pairs if y == 0]
    assert len(good) > 500 and sum(good) >= 0.99 * len(good)
    assert len(bad) > 80 and sum(bad) <= 0.03 * len(bad)


@pytest.mark.parametrize("text", [b"", b" \n\t", b"one", "Ünïcödé 日本語 \U0001f600".encode(), b"a!! B?? c1 !!!!\n\n" * 900, bytes(range(128))])
def test_statistics(text):
    """Counts by plain loops."""
    words = text.split()
    lines = [w for w in text.split(b"\n") if w.strip()]
    s = text.decode()
    letters = sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in s)
    arc = lambda part, whole: np.arcsin(np.sqrt(min(1, part / (whole + M.FEW))))
    ratio = {
        "upper": (sum("A" <= c <= "Z" for c in s), letters), "digit": (sum(c in "0123456789" for c in s), len(s)), "blank": (sum(c in " \t" for c in s), len(s)), "beyond": (sum(ord(c) > 127 for c in s), letters),
        "mark": (sum(c in ".,;:!?'\"()-" for c in s), len(s)), "repeated_words": (len(words) - len(set(words)), len(words)), "repeated_lines": (len(lines) - len(set(lines)), len(lines)), "short_words": (sum(len(w) <= 3 for w in words), len(words)),
        "repeated_pairs": (max(0, len(words) - 1) - len({(a, b) for a, b in zip(words, words[1:])}), len(words)), "top_word": (sorted((words.count(w) for w in set(words)), reverse=True)[3:4] or [0]) + [len(words)],
    }
    got = dict(zip(M.FEATURES, M.statistics([b"other", text])[1]))
    assert {k: got[k] for k in ratio} == {k: round(arc(*v) * M.GRID) for k, v in ratio.items()}
    assert got["length"] == round(np.log1p(len(s)) * M.GRID) and got["words"] == round(np.log1p(len(words)) * M.GRID)


def test_few_labels():
    """One class or none: constant scores; a class of one row leans on the pooled covariance."""
    one = [[[0] * D] * D] * 2
    assert M.Model.of([0, 0], [[0] * D] * 2, one).scores(np.zeros((2, D))).tolist() == [0.5, 0.5]
    assert M.Model.of([3, 0], [[0] * D] * 2, one).scores(np.zeros((1, D))).tolist() == [0.0]
    assert M.Model.of([0, 3], [[0] * D] * 2, one).scores(np.zeros((1, D))).tolist() == [1.0]
    r = np.random.default_rng(2)
    rows, labels = r.integers(0, 3000, (41, D)), np.array([1] * 40 + [0])
    own = [rows[labels == c] for c in (0, 1)]
    model = M.Model.of([1, 40], [o.sum(axis=0).tolist() for o in own], [(o.T @ o).tolist() for o in own])
    assert np.allclose(model.scores(rows), plain_scores(rows, rows, labels), atol=1e-6)
    assert model.scores(rows[40:])[0] < 0.5


def test_edges(spark, docs, no_docs):
    """Nulls, empty and long texts, repeated ids, clashing columns; labels that are null, disagree, repeat or are no class."""
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 1), (3, 1, 0), (3, 0, 0), (5, 1, 1), (5, 1, 1), (6, 7, 0), (None, 1, 0), (77, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").withColumn("x", M.F.lit("a"))
    got = M.score_quality(docs.withColumn("quality", M.F.lit(1)), labels).collect()
    rows = docs.collect()
    assert sorted(repr(g.doc_id) for g in got) == sorted(repr(r.doc_id) for r in rows)
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) and g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    x = M.statistics([(r.text or "").encode() for r in rows])
    known = {0: 1, 1: 0, 5: 1, 9: 0}
    learn = [k for k, r in enumerate(rows) if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5]
    label = np.array([known[rows[k].doc_id] for k in learn])
    expected = dict(zip(map(repr, [r.doc_id for r in rows]), plain_scores(x, x[learn], label) if len(set(label)) == 2 else [float(label[0])] * len(rows)))
    assert all(abs(g.score - expected[repr(g.doc_id)]) < 1e-5 for g in got)
    assert M.score_quality(no_docs, labels).collect() == []
    assert {g.score for g in M.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_names(spark):
    docs = spark.createDataFrame([("a.1", "some text here", 1), ("b`2", None, 2)], "`the id.` string, `te``xt` string, held_out int")
    labels = spark.createDataFrame([("a.1", 1), ("b`2", 0)], "`the id.` string, `q.` int")
    got = M.score_quality(docs, labels, "the id.", "te`xt", "q.").collect()
    assert sorted(g[0] for g in got) == ["a.1", "b`2"]
