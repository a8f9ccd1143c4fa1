"""Search over small corpora, and BM25 against SQLite's full-text index."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from lexivault.functions.fts import QuerySyntaxError, parse
from lexivault.operators import catalog, lexical
from lexivault.plans.search import Filters, Searcher
from lexivault.schemas import CHUNKS, EDGES, EMBEDDINGS, SYMBOLS

TEXTS = [
    (1, "alpha beta gamma alpha", "foo", None), (2, "beta beta delta", "alpha", "scope gamma"), (3, "über Größe naïve alpha", None, "a.b_c"), (4, "gamma-ray gammas gam", "gamma", None),
    (5, "alpha x x x beta", None, None), (6, "", None, None), (7, "the alpha beta the end", "end", "beta"), (8, "delta epsilon", "zeta", None),
]
QUERIES = [
    "alpha", "alpha beta", "alpha OR delta", "alpha NOT gamma", '"alpha beta"', "gam*", "name:gamma", "{name scope}:gamma", "-content:beta", "alpha AND (beta OR gamma)", "Uber", "grosse", "größe",
    "^alpha", "NEAR(alpha beta, 3)", "NEAR(alpha beta, 1)", "alpha + beta", '"gamma ray"', "beta beta", "the", "content:alpha delta", "b_c", "alpha beta NOT gamma", "alpha OR beta NOT delta", "nothing", '""',
]


def chunks(spark, rows):
    return spark.createDataFrame([(i, f"p{i}", "python", "p", 1, 1, "function", name, scope, text) for i, text, name, scope in rows], CHUNKS)


@pytest.fixture(scope="module")
def corpus(spark):
    return chunks(spark, TEXTS).cache()


@pytest.mark.parametrize("query", QUERIES)
def test_bm25_is_sqlites(corpus, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(content, name, scope)")
    con.executemany("INSERT INTO t(rowid, content, name, scope) VALUES (?, ?, ?, ?)", TEXTS)
    want = {i: -s for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (query,))}
    got = {r.id: r.score for r in lexical.bm25(corpus, query).collect()}
    assert set(got) == set(want)
    if "NEAR" not in query:
        for i in want:
            assert got[i] == pytest.approx(want[i], abs=1e-9)


@pytest.mark.parametrize("query", ["foo.bar", "what?", "a-b", "nocolumn:x", "(alpha", "alpha AND", "NEAR(a", '"open', "OR", "*"])
def test_syntax_errors(query):
    with pytest.raises(QuerySyntaxError):
        parse(query)


def test_postings_give_the_same_scores(corpus):
    """Every form of query, from stored places and from the texts."""
    index, stats = lexical.postings(corpus).cache(), lexical.corpus_stats(corpus).cache()
    forms = ["alpha", "alpha beta", "alpha OR gamma", "alpha NOT beta", "gam*", '"alpha beta"', '"alpha be"*', "alpha + beta", "^alpha", '^"alpha beta"', "name:alpha", "{name scope}: alpha", "-content: alpha", "NEAR(alpha beta)", "NEAR(alpha gamma, 1)", '(alpha OR "beta gamma") AND gam* NOT delta', "nothing", "alpha alpha"]
    for q in forms:
        scan = {r.id: r.score for r in lexical.bm25(corpus, q).collect()}
        held = {r.id: r.score for r in lexical.bm25_postings(index, stats, q).collect()}
        assert held.keys() == scan.keys(), q
        assert all(held[k] == pytest.approx(scan[k], abs=1e-12) for k in scan), q
    some = corpus.where("id % 2 = 0")
    assert {r.id: round(r.score, 9) for r in lexical.bm25_postings(index, stats, "alpha", some.select("id")).collect()} == {r.id: round(r.score, 9) for r in lexical.bm25(corpus, "alpha", F.col("id") % 2 == 0).collect()}


def test_statistics_are_not_filtered(corpus):
    from pyspark.sql import functions as F

    plain = {r.id: r.score for r in lexical.bm25(corpus, "alpha").collect()}
    few = {r.id: r.score for r in lexical.bm25(corpus, "alpha", F.col("id") < 3).collect()}
    assert few == {i: plain[i] for i in few} and set(few) == {1, 2}


E1, E2 = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]


def searcher(spark, rows, vectors, query=E1):
    return Searcher(chunks(spark, rows), spark.createDataFrame(vectors, EMBEDDINGS), lambda _: query)


def test_modes_and_fusion(spark):
    s = searcher(spark, [(1, "lexical winner", None, None), (2, "dense winner", None, None), (3, "noise", None, None)], [(1, E2), (2, E1), (3, [0.0, 0.0, 1.0, 0.0])])
    lexical_ = s.search("lexical", mode="bm25").collect()
    assert [(r.path, r.score) for r in lexical_] == [("p1", 1 / 61)]
    assert s.search("lexical", mode="dense").first().path == "p2"
    both = s.search("lexical").collect()
    assert [r.path for r in both] == ["p1", "p2", "p3"]
    assert both[0].score == pytest.approx(1 / 61 + 1 / 62) and both[1].score == pytest.approx(1 / 61)
    assert both[0].asDict().keys() == {"path", "start_line", "end_line", "language", "kind", "name", "scope", "excerpt", "score"}
    with pytest.raises(ValueError):
        s.search("x", mode="other")
    with pytest.raises(ValueError):
        s.search("x", k=0)
    with pytest.raises(ValueError):
        Searcher(s.chunks).search("x")
    assert Searcher(s.chunks).search("lexical", mode="bm25").count() == 1  # words need no backend


def test_ties_go_to_the_dense_rank_and_then_the_id(spark):
    s = searcher(spark, [(7, "only words", None, None), (8, "other", None, None)], [(8, E1)])
    assert [r.path for r in s.search("only").collect()] == ["p8", "p7"]


def test_filters_excerpt_and_caps(spark):
    long = "\n".join(f"line{k} matchme" for k in range(100)) + "\n"
    rows = [(1, f"src/foo/a.py", "python", "p", 1, 1, "function", None, None, long), (2, "src/foo/a.go", "go", "p", 1, 1, "function", None, None, "matchme"), (3, "src/bar/c.py", "python", "p", 1, 1, "class", None, None, "matchme")]
    c = spark.createDataFrame(rows, CHUNKS)
    s = Searcher(c, spark.createDataFrame([(k, E1) for k in (1, 2, 3)], EMBEDDINGS), lambda _: E1)
    paths = lambda **f: sorted(r.path for r in s.search("matchme", filters=Filters(**f)).collect())
    assert paths(lang="go") == ["src/foo/a.go"] and paths(kind="class") == ["src/bar/c.py"]
    assert paths(path_glob="src/foo/*") == ["src/foo/a.go", "src/foo/a.py"] and paths(path_glob="src/*/[ab].??") == ["src/foo/a.go", "src/foo/a.py"]
    assert paths(lang="go", kind="class") == []
    first = s.search("matchme", mode="bm25", filters=Filters(kind="function", lang="python")).first()
    assert first.excerpt == "\n".join(f"line{k} matchme" for k in range(30))
    assert s.search("matchme", mode="bm25", bm25_k=2, k=50).count() == 2
    assert s.search('"what? ever"', mode="bm25").count() == 0
    assert s.search("what? matchme.", mode="bm25", sanitize=True).count() == 0


def test_symbols_and_graph(spark):
    c = spark.createDataFrame([(1, "b.py", "python", "p", 5, 9, "module", None, "S", "x"), (2, "a.go", "go", "p", 1, 2, "module", None, None, "y")], CHUNKS)
    s = spark.createDataFrame([(1, 1, "foo", "def", 3), (2, 1, "foobar", "def", 1), (3, 2, "foo", "def", 2), (4, 1, "foo", "ref", 8), (5, 1, "Foo", "def", 4), (6, 1, r"f\o", "def", 6)], SYMBOLS)
    e = spark.createDataFrame([(1, "foo", "import", '{"names": []}'), (1, "foo", "import", None), (2, "baz", "listen", None), (1, "foobar", "import", None)], EDGES)
    names = lambda *a, **k: [(r.path, r.line, r.name) for r in catalog.symbols(s, c, *a, **k).collect()]
    assert names("foo") == [("a.go", 2, "foo"), ("b.py", 1, "foobar"), ("b.py", 3, "foo")]
    assert names("foo", exact=True, language="python") == [("b.py", 3, "foo")] and names("foo", kind="ref") == [("b.py", 8, "foo")]
    assert names("f_o", exact=False, language="python") == [("b.py", 1, "foobar"), ("b.py", 3, "foo"), ("b.py", 6, r"f\o")] and names("\\") == [("b.py", 6, r"f\o")]
    hits = catalog.callers(e, c, "foo").collect()
    assert [(h.path, h.scope, h.start_line, h.dst_name) for h in hits] == [("b.py", "S", 5, "foo")] * 2 + [("b.py", "S", 5, "foobar")]
    assert catalog.callers(e, c, "foo", exact=True, resolve=s).first().resolved and not catalog.callers(e, c, "baz", resolve=s).first().resolved
    assert [(d.kind, d.dst_name, d.meta) for d in catalog.deps(e, c, "b.py").collect()][0][1] == "foo" and catalog.deps(e, c, "b*").collect() == []
    with pytest.raises(ValueError):
        catalog.symbols(s, c, "x", kind="other")
