from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexivault.llm import fill_middle as M
from pyspark.sql import functions as F

from ..oracle import compare


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    n, m, different = compare(spark, M.op13_fill_middle, M.ORACLE, f"/root/testdata/{sf}")
    assert n == m > 0 and not different, different


@given(st.lists(st.integers(0, 1 << 36), max_size=60))
def test_elias_fano(values):
    values = sorted(values) or [0]
    made = M.EliasFano.of(np.array(values, dtype=np.int64))
    assert [made.select(k) for k in range(len(values))] == values


@pytest.mark.parametrize("text", ["", "a", "日本語" * 3000, "é😀x" * 5000, "plain " * 4000])
def test_boundaries(text):
    made = M.EliasFano.of(M.boundaries(text.encode()))
    assert made.n == len(text) + 1
    for k in {0, len(text) // 3, len(text) // 2, len(text)} | set(range(min(len(text), 2100))):
        assert made.select(k) == len(text[:k].encode())


@settings(deadline=None, max_examples=15)
@given(st.lists(st.tuples(st.text("ab<>PSMé😀\n", max_size=12), st.floats(0, 1), st.floats(0, 1)), min_size=1, max_size=8))
def test_restored(spark, rows):
    """Any text without a marker comes back, whatever its own signs put together with the markers."""
    marks = (M.PREFIX, M.SUFFIX, M.MIDDLE)
    rows = [(t, *sorted((int(x * len(t)), int(y * len(t))))) for t, x, y in rows if not any(m in t for m in marks)]
    if rows:
        made = [(t, form, M.arrange(t.encode(), form, len(t[:a].encode()), len(t[:b].encode())).decode()) for t, a, b in rows for form in ("plain", "psm", "spm")]
        df = spark.createDataFrame(made, "t string, form string, output string")
        assert df.where(M.restored(F.col("output"), F.col("form")) != F.col("t")).count() == 0


def plain_cut(ident, text, seed=1):
    """The contract in plain Python."""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return ident, n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return ident, n, form, a, b - a, f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


def by_text(rows):
    return sorted(map(repr, rows))


def test_edges(docs, no_docs):
    got = [tuple(r) for r in M.fill_middle(docs).collect()]
    assert by_text(got) == by_text(plain_cut(r.doc_id, r.text) for r in docs.collect())
    assert M.fill_middle(no_docs).collect() == []


def test_markers_and_names(spark):
    texts = [f"a{m}b" for m in ("<P>", "<S>", "<M>", "<p>", "P>", "<<P", "<<", ">")]
    rows = spark.createDataFrame([(f"k{k}", t, "x", 3) for k, t in enumerate(texts * 20)], "`an id.` string, `the``text` string, digest string, n int")
    got = M.fill_middle(rows, "an id.", "the`text", seed=7)
    assert by_text(tuple(r) for r in got.collect()) == by_text(plain_cut(f"k{k}", t, 7) for k, t in enumerate(texts * 20))


def test_hot_text(spark):
    """A text of most rows is dealt to many parts; every row is cut as if it stood alone, and each text is indexed once."""
    hot = "one text of nearly all documents, with é and 日本語 in it. " * 20
    rows = spark.range(0, 6000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, hot).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = M.fill_middle(rows).collect()
    assert by_text(tuple(r) for r in got) == by_text(plain_cut(r.doc_id, r.text) for r in rows.collect())
    index = M.distinct_texts(rows).select("copies").collect()
    assert sorted(r.copies for r in index) == [1] * 600 + [5400]
