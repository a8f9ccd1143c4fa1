from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from lexivault.llm import language_id as L


def test_gradients_against_differences():
    r = np.random.default_rng(0)
    m = L.new_model(["a", "b", "c"], 5)
    x, label, mask = r.integers(97, 123, (11, 7)).astype(np.uint8), r.integers(0, 3, 7), (r.random((11, 7)) < 0.8).astype(np.float32)
    _, grads = L.gradients(m, x, label, mask)
    for w, g in zip(m.weights(), grads):
        for flat in np.argsort(-np.abs(g).ravel())[:3]:
            k = np.unravel_index(flat, g.shape)
            old = w[k]
            w[k] = old + 1e-2
            up = L.gradients(m, x, label, mask)[0]
            w[k] = old - 1e-2
            down = L.gradients(m, x, label, mask)[0]
            w[k] = old
            assert abs((up - down) / 2e-2 - g[k]) < 2e-3


def test_window_lanes_agree_with_one_by_one():
    m = L.new_model(["a", "b"], 6)
    texts = [b"abc def", b"x" * 300, b"", "Grüße".encode(), b"12 !"]
    pooled, voted, runs = L.predict(m, texts, spans=True)
    for k, t in enumerate(texts):
        alone, share, _ = L.predict(m, [t])
        np.testing.assert_allclose(pooled[k], alone[0], atol=1e-6)
        np.testing.assert_allclose(voted[k], share[0], atol=1e-6)
        assert sum(n for _, n, _ in runs[k]) == len(t)  # every position has a label
    assert pooled[2].sum() == 0 and pooled[4].sum() == 0
    np.testing.assert_allclose(pooled[0].sum(), 1, atol=1e-5)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in L.op3_language_id(spark, d).collect()}
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n")).collect()
    assert len(rows) == len(truth)
    right = [rows[t.doc_id].lang_pred == t.lang for t in truth if rows[t.doc_id].held_out]
    assert np.mean(right) > 0.98
    for t in truth:
        assert rows[t.doc_id].held_out == (zlib.crc32(str(t.doc_id).encode()) % 4 == 2)
        assert 0 <= rows[t.doc_id].score <= 1


def test_held_out_rows_teach_nothing(spark):
    d = spark.createDataFrame([(k, "only here" if zlib.crc32(str(k).encode()) % 4 == 2 else "other text", "aa" if zlib.crc32(str(k).encode()) % 4 == 2 else "bb") for k in range(60)], "doc_id long, text string, lang string")
    parts, labels, langs = L.training_windows(d)
    assert langs == ["bb"] and set(parts) == {b"other text"} and set(labels) == {0}


def test_edges(spark, docs, no_docs):
    model = L.fit_language_model(docs.select("doc_id", "text", "lang"), steps=5)
    rows = L.identify(docs, model, keep=("doc_id", "n", "lang"), spans=True).collect()
    assert len(rows) == 12
    by = {(r.doc_id, r.n): r for r in rows}
    for key in ((2, 3), (3, None), (4, 4), (6, 7)):
        assert by[key].lang_pred == "und" and by[key].score == 0
    assert by[(7, 8)].lang_pred in model.langs
    assert sum(x.length for x in by[(None, 6)].label_runs) == len("une phrase sans numéro".encode())
    assert L.identify(no_docs, model).collect() == []
    assert L.fit_language_model(no_docs) is None
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}


def test_network_against_a_plain_loop():
    """Pooled probabilities of whole texts, by one state at a time and one byte at a time."""
    m = L.new_model(["a", "b", "c"], 4, noise=True)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(x, d):
        out, h = {}, np.zeros(4)
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            given, inner = m.table[d][x[t]].astype(float), m.inner[d].astype(float) @ h
            reset, update = sigmoid(given[:4] + inner[:4]), sigmoid(given[4:8] + inner[4:8])
            h = (1 - update) * h + update * np.tanh(given[8:] + reset * (inner[8:] + m.bias[d]))
            out[t] = h
        return out

    for text in ("Wörter and WORDS 12", "x " * 150, "émoi"):
        data = text.encode().translate(L.FOLD)
        total, letters = np.zeros(4), 0
        for a in range(0, len(data), L.WINDOW):
            x = data[a : a + L.WINDOW].ljust(L.WINDOW, b"\0")
            there, back = states(x, 0), states(x, 1)
            for t, byte in enumerate(x):
                if byte >= 128 or 97 <= byte <= 122:
                    e = np.exp(m.out @ np.concatenate([there[t], back[t]]) + m.out_bias)
                    total, letters = total + e / e.sum(), letters + 1
        np.testing.assert_allclose(L.predict(m, [text.encode()])[0][0], total / letters, atol=1e-5)


def test_languages_are_not_limited(spark):
    """A language beyond the 64th is learned like any other."""
    rows = [(100 * k + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)}{j} " * 12, f"l{k:03}") for k in range(90) for j in range(4)]
    parts, labels, langs = L.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(langs) == 90 and set(labels) == set(range(90))
    m = L.train(parts, labels, langs, steps=3)
    assert L.predict(m, [b"some text"])[0].shape == (1, 91)


def test_sample_is_bounded_whatever_repeats(spark):
    same = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'the same text' as text", "'en' as lang")
    other = spark.range(3000).selectExpr("1L as doc_id", "concat('text number ', id) as text", "'en' as lang")
    parts, _, _ = L.training_windows(same.union(other), sample_docs=20, windows=3)
    assert 20 <= len(parts) <= 60


def test_noise_is_told_from_languages(spark):
    d = "/root/testdata/sf0.01"
    m = L.fit_language_model(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang"))
    runs = [b"deadbeef0123" * 40, b"QWJjZGVm/+9kZmFzZGZhc2Rm" * 20, b"a1b2c3 d4e5f6 " * 20]
    assert (L.predict(m, runs)[0][:, -1] > 0.8).all()
    texts = [r.text.encode() for r in spark.read.parquet(f"{d}/documents.parquet").where("length(text) > 60").collect()]
    noise = L.predict(m, texts)[0][:, -1]
    assert (noise < 0.5).mean() > 0.995
    upper = L.predict(m, [t.upper() for t in texts[:200]])[0][:, -1]
    assert (upper < 0.5).mean() > 0.98


def test_kept_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "some words", 5, "x")], "doc_id long, text string, c0 int, value string")
    r = L.identify(d, None, keep=("value", "c0", "text", "doc_id")).first()
    assert (r.value, r.c0, r.text, r.doc_id, r.lang_pred) == ("x", 5, "some words", 1, "und")
