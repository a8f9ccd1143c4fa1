"""Many queries at once, and postings in blocks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivault.operators import batch, blocks, lexical
from lexivault.operators.blocks import BlockIndex, plain_words, top_batch, top_query
from lexivault.operators.skew import salted_join


def brute_nearest(vectors, queries, k):
    out = []
    for q, v in queries:
        found = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in vectors if len(x) == len(v))
        out += [(q, i, round(d, 9), r + 1) for r, (d, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "k", "part"), [(700, 7, 4), (40, 50, 2), (5, 3, 32)])
def test_nearest(spark, monkeypatch, n, k, part):
    """Against all pairs: copies, ties, two lengths, several blocks of queries and packs of vectors."""
    monkeypatch.setattr(batch, "QUERIES", 20)
    monkeypatch.setattr(batch, "BYTES", 100 * 8 * 8)
    r = np.random.default_rng(n)
    rows = [(k, [float(v) for v in r.integers(-2, 3, 8)]) for k in range(n)] + [(n + k, [1.0, float(k)]) for k in range(9)]
    asked = rows[::9] + [(-1, [0.5] * 8), (-2, [3.0, 3.0])]
    got = batch.nearest_batch(spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3), spark.createDataFrame(asked, "query long, embedding array<double>"), k, part)
    assert sorted((x.query, x.id, round(x.distance, 9), x.rank) for x in got.collect()) == brute_nearest(rows, asked, k)


def test_nearest_edges(spark):
    kind = "long, embedding array<double>"
    rows = [(1, [1e200, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 1e-9])]
    vectors = spark.createDataFrame(rows, f"chunk_id {kind}")
    queries = spark.createDataFrame([(2, [1.0, 0.0]), (3, None), (None, [1.0, 0.0])], f"query {kind}")
    got = batch.nearest_batch(vectors, queries, 4).collect()
    assert sorted((x.query, x.rank, x.id) for x in got) == [(2, 1, 2), (2, 2, 7), (2, 3, 7), (2, 4, 8)]
    assert [x.distance for x in got if x.id == 8] == [1e-9]
    assert batch.nearest_batch(vectors, queries.limit(0), 4).collect() == []
    assert batch.nearest_batch(vectors.limit(0), queries, 4).collect() == []


WORDS = [f"w{k}" for k in range(60)]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows = []
    for k in range(3000):
        said = [WORDS[min(59, int(r.expovariate(0.12)))] for _ in range(r.choice([0, 1, 3, 20, 90]))]
        rows.append((k * 3 - 900, f"p{k}", "x", "y", 1, 1, "k", "name" if k % 50 == 0 else None, None, " ".join(said)))
    chunks = spark.createDataFrame(rows, "id long, path string, language string, project string, start_line int, end_line int, kind string, name string, scope string, content string").cache()
    places = lexical.postings(chunks).cache()
    return chunks, BlockIndex.of(places, lexical.corpus_stats(chunks)).stored()


def brute(chunks, words, k, every):
    rows = [(r.id, (r.content + " " + (r.name or "")).split()) for r in chunks.collect()]
    mean = sum(len(t) for _, t in rows) / len(rows)
    df = {w: sum(w in t for _, t in rows) for w in words}
    scored = []
    for i, t in rows:
        held = [w for w in words if w in t]
        if held and (not every or len(held) == len(words)):
            idf = {w: max(math.log((len(rows) - df[w] + 0.5) / (df[w] + 0.5)), 0) or 1e-6 for w in held}
            scored.append((-round(sum(idf[w] * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in held), 9), i))
    return [(i, round(-s, 6), n + 1) for n, (s, i) in enumerate(sorted(scored)[:k])]


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("words", [["w0"], ["w0", "w1"], ["w3", "w40", "w0"], ["w59", "name"], ["w1", "nothing"], ["nothing"]])
def test_top_query(corpus, words, every):
    chunks, index = corpus
    got = [(r.id, round(r.score, 6), r.rank) for r in top_query(index, words, 15, every).orderBy("rank").collect()]
    assert got == brute(chunks, words, 15, every)


@pytest.mark.parametrize("every", [False, True])
def test_top_batch(spark, corpus, every):
    chunks, index = corpus
    r = random.Random(8)
    queries = {q: r.sample(WORDS, r.choice([1, 2, 3, 9])) for q in range(25)} | {77: ["nothing"], 78: ["w0", "nothing"]}
    rows = [(q, w) for q, words in queries.items() for w in words] + [(1, None), (None, "w0"), (3, queries[3][0])]
    got = {}
    for x in top_batch(index, spark.createDataFrame(rows, "query long, term string"), 12, every).orderBy("query", "rank").collect():
        got.setdefault(x.query, []).append((x.id, round(x.score, 6), x.rank))
    expected = {q: found for q, words in queries.items() if (found := brute(chunks, words, 12, every))}
    assert got == expected


def test_blocks_are_skipped(spark, corpus):
    """A word of more than half of the rows: few of its blocks are read, and what bounds them reaches the scan."""
    chunks, index = corpus
    total = index.blocks.where("term = 'w0'").count()
    opened: list = []
    found = top_query(index, ["w0"], 10, opened=opened)
    assert index.dictionary.where("term = 'w0'").first().docs > 0.4 * chunks.count()
    assert opened[0].count() <= 0.4 * total
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(impact" in plan.replace(" ", "") and "EqualTo(term,w0)" in plan
    opened = []
    top_batch(index, spark.createDataFrame([(1, "w0")], "query long, term string"), 10, opened=opened).collect()
    assert sum(t.count() for t in opened) <= 0.5 * total


def test_bounds_hold_when_the_mean_moves(corpus):
    """Blocks made with another mean length still bound every score."""
    _, index = corpus
    for mean in (3.0, 20.0, 400.0):
        each = index.blocks.select("impact", "avgdl", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        assert each.where(blocks.impact(F.col("p.tfs"), F.col("p.dls"), F.lit(mean)) > blocks._head(F.lit(mean)) + 1e-9).isEmpty()


@pytest.mark.parametrize(("query", "expected"), [("a", (["a"], False)), ("a OR b OR c", (["a", "b", "c"], False)), ("a b", (["a", "b"], True)), ("a AND b", (["a", "b"], True)), ("a OR b AND c", None), ("a*", None), ('"a b"', None), ("^a", None), ("name:a", None), ("a NOT b", None), ("a a", None), ("NEAR(a b)", None)])
def test_plain_words(query, expected):
    assert plain_words(query) == expected


def test_salted_join(spark):
    rows = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("key"), "id")
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4), (None, 5)], "key string, v int")
    got = salted_join(rows, other, "key", most=100)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in rows.join(other, "key").collect())


def test_blocks_of_texts(spark, corpus, monkeypatch):
    """Made of texts, where no word is moved, they are the blocks of postings; ranges of ids stay whole in small runs."""
    monkeypatch.setattr(blocks, "BYTES", 1000)
    chunks, index = corpus
    mean = index.stats.first().avgdl
    made = blocks.gathered_texts(chunks.repartition(3), mean)
    fields = lambda df: sorted((r.term, r.bucket, r.n, round(r.impact, 12), r.avgdl, r.ids, r.tfs, r.dls) for r in df.collect())
    assert fields(made) == fields(index.blocks)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(span" in plan(made) and "Exchange hashpartitioning(term" not in plan(made)
    assert "Exchange" not in plan(lexical.postings(spark.createDataFrame([(1, "a b a", None, "b")], "id long, content string, name string, scope string")))


def test_postings_places(spark):
    rows = [(7, "a b a", "b", None), (8, None, None, None), (9, "b", None, "a a")]
    got = lexical.postings(spark.createDataFrame(rows, "id long, content string, name string, scope string").coalesce(1)).collect()
    assert [tuple(r) for r in got] == [("a", 7, 4, [1, 3], [], []), ("a", 9, 3, [], [], [1, 2]), ("b", 7, 4, [2], [1], []), ("b", 9, 3, [1], [], [])]
