"""The learned embedding: against a dense decomposition, orthogonality, and neighbours of held-out texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lexivault.errors import IndexError_
from lexivault.functions.embedding import from_config
from lexivault.operators import lsi
from lexivault.operators.lsi import SvdBackend, SvdModel
from lexivault.plans.build import _meta

TOPICS = [[f"{t}{k}" for k in range(25)] for t in ("sea", "law", "code", "food", "war")]


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        topic = r.randrange(5)
        out.append((topic, " ".join(r.choices(TOPICS[topic], k=12) + r.choices(["the", "of", "and", "a"], k=8))))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rows = texts(1, 400)
    df = spark.createDataFrame(rows, "topic int, content string").repartition(5)
    return rows, df, SvdModel.fit(df, dim=6, buckets=512, passes=4)


def test_against_dense(fitted):
    """The leading values and directions of the whole matrix, idf by hand."""
    rows, _, model = fitted
    held = [lsi.buckets_of(t, 512) for _, t in rows]
    df = np.zeros(512)
    for at, _ in held:
        df[at] += 1
    idf = np.where(df > 0, np.log((len(rows) + 1) / (df + 0.5)), 0)
    assert np.allclose(idf, model.idf)
    a = np.zeros((len(rows), 512))
    for k, (at, w) in enumerate(held):
        a[k, at] = w * idf[at] / np.linalg.norm(w * idf[at])
    _, values, v = np.linalg.svd(a, full_matrices=False)
    # the last ones of a flat spectrum are only near; five topics give five that stand out
    assert np.allclose(model.values[:5], values[:5], rtol=1e-3)
    assert np.abs(np.diag(v[:5] @ model.vectors[:, :5])).min() > 0.99
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(6), atol=1e-5)


def test_held_out_neighbours(fitted):
    """The nearest texts of unseen ones are of their topic, also where they share few words."""
    rows, _, model = fitted
    backend = SvdBackend(model)
    known, new = backend.encode([t for _, t in rows]), texts(2, 60)
    near = np.argsort(-(backend.encode([t for _, t in new]) @ known.T), axis=1)[:, :5]
    right = np.mean([[rows[j][0] == topic for j in js] for (topic, _), js in zip(new, near)])
    assert right > 0.95


def test_backend(spark, fitted, tmp_path):
    _, df, model = fitted
    backend = SvdBackend(model)
    assert (backend.name, backend.dim) == ("svd:6", 6) and _meta(backend, 1)["embed_dim"] == "6" and _meta(backend, 1)["embed_model"] == "svd:6"
    some = df.limit(20).select("content", backend.column(df.content).alias("v")).collect()
    assert all(np.allclose(r.v, backend.encode([r.content])[0], atol=1e-6) for r in some)
    assert backend.encode(["", "zzz unknown"]).shape == (2, 6) and backend.encode([]).shape == (0, 6) and not backend.encode([""]).any()
    model.save(spark, str(tmp_path / "m"))
    again = SvdModel.load(spark, str(tmp_path / "m"))
    made = from_config("svd", f"svd:{tmp_path / 'm'}", "cpu")
    assert made.dim == 6 and np.array_equal(made.encode(["sea1 sea2"]), backend.encode(["sea1 sea2"]))
    with pytest.raises(IndexError_):
        from_config("svd", "svd", "cpu")
    assert np.array_equal(again.vectors, model.vectors) and np.allclose(again.idf, model.idf) and np.allclose(again.values, model.values)


def test_small(spark):
    kind = "content string"
    one = SvdModel.fit(spark.createDataFrame([("one word",), (None,), ("",)], kind), dim=4, buckets=64)
    assert one.values[0] > 0.9 and np.allclose(one.values[1:], 0, atol=1e-6) and np.abs(SvdBackend(one).encode(["one word"])[0, 0]) > 0.99
    none = SvdModel.fit(spark.createDataFrame([], kind), dim=4, buckets=64)
    assert not none.vectors.any() and not SvdBackend(none).encode(["x"]).any()
    part = SvdModel.fit(spark.createDataFrame([(t,) for _, t in texts(3, 300)], kind), dim=4, buckets=256, sample=60)
    assert np.linalg.norm(part.vectors[:, 0]) > 0.99
