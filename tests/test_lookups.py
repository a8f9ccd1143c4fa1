"""Names by a part of them, what can be reached in a graph, and how tables lie on disk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexivault.operators import catalog, reach as reaching
from lexivault.operators.catalog import closure
from lexivault.operators.reach import reach
from lexivault.operators.trigrams import NameIndex, needed
from lexivault.sources.layout import MODE, Layout
from lexivault.functions.text import like_substring
from lexivault.queries import QUERIES


@pytest.fixture(scope="module")
def names(spark):
    r = random.Random(3)
    found = ["".join(r.choices("abcAB_%\\é日", k=r.randrange(0, 14))) for _ in range(2500)] + ["", "ab", "abc", "abcabc", "a\U0001f600bc", None]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(found + found[:300])], "id int, name string").cache()
    return rows, NameIndex.of(rows)


@pytest.mark.parametrize("pattern", ["abc", "abcab", "ab", "a", "", "%", "_", "a_c", "ab%ca", "abc_ab", "AbA", "日é", "\\a", "zzz", "abcabcabc", "a%%b", "___", "😀bc"])
def test_names(names, pattern):
    rows, index = names
    expected = [tuple(r) for r in rows.where(like_substring(F.col("name"), pattern)).collect()]
    assert sorted(tuple(r) for r in index.rows(rows, pattern).collect()) == sorted(expected)


def test_lists_are_read_by_run(names):
    _, index = names
    assert needed("abcd%ef_ghi") == ["abc", "bcd", "ghi"] and needed("ab%c_d") == []
    assert "In(run,[abc,bca])" in index.find("abca")._jdf.queryExecution().executedPlan().toString().replace(" ", "")


def by_hand(links, sources):
    out = set()
    for s in {s for s in sources if s is not None}:
        depth, front, seen = 0, {s}, {s}
        while front:
            out |= {(s, n, depth) for n in front}
            front = {b for a, b in links if a in front and b is not None} - seen
            seen |= front
            depth += 1
    return out


@pytest.mark.parametrize("kind", ["random", "path", "cycle", "star", "none"])
def test_closure(spark, kind):
    r = random.Random(1)
    links = {"random": [(r.randrange(40), r.randrange(40)) for _ in range(60)] + [(None, 1), (1, None)], "path": [(k, k + 1) for k in range(12)], "cycle": [(k, (k + 1) % 5) for k in range(5)] * 2, "star": [(k, 0) for k in range(30)] + [(0, k + 50) for k in range(30)], "none": []}[kind]
    sources = [0, 3, 3, 99, None]
    got = closure(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(s,) for s in sources], "node long"))
    assert sorted((x.source, x.node, x.depth) for x in got.collect()) == sorted(by_hand(links, sources))


@pytest.fixture
def layout(spark):
    made = Layout(spark, "layout_test", 4)
    chunks = spark.range(200).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.element_at(F.array(F.lit("de"), F.lit("en"), F.lit(None).cast("string")), (F.col("id") % 3 + 1).cast("int")).alias("language"))
    vectors = spark.range(0, 200, 2).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    yield made.write(chunks, vectors)
    made.drop()


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_moves_nothing(layout):
    found = layout.with_vectors("de")
    assert sorted(r.id for r in found.collect()) == [k for k in range(0, 200, 2) if k % 3 == 0]
    text = plan(found)
    assert "Exchange" not in text and "Broadcast" not in text and "SortMergeJoin" in text
    assert "PartitionFilters: [isnotnull(language" in text
    assert len(layout.chunks.where("language = 'de'").inputFiles()) <= 4 and "Exchange" not in plan(layout.with_vectors())


def test_replace(layout, spark):
    before = {f for f in layout.chunks.where("language = 'en'").inputFiles()}
    layout.replace(layout.chunks.where("language = 'de' AND id < 50").withColumn("path", F.upper("path")))
    got = {(r.id, r.path, r.language) for r in layout.chunks.collect()}
    assert got == {(k, f"P{k}", "de") for k in range(0, 50, 3)} | {(k, f"p{k}", "en" if k % 3 == 1 else None) for k in range(200) if k % 3}
    assert {f for f in layout.chunks.where("language = 'en'").inputFiles()} == before
    assert spark.conf.get(MODE, "static").lower() == "static" and "Exchange" not in plan(layout.with_vectors("de"))


def test_closure_walks_links_once_for_many_sources(spark, monkeypatch):
    """600 sources on a ring with chords: rows of the walk are far fewer than pairs, and bits of every long tell."""
    links = [(k, (k + 1) % 600) for k in range(600)] + [(k, (k * 7 + 3) % 600) for k in range(600)]
    made, real = [], catalog.stored
    monkeypatch.setattr(catalog, "stored", lambda df, name: made.append((name, df)) or real(df, name))
    got = closure(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(s,) for s in range(600)], "node long"))
    assert got.count() == 600 * 600
    assert {(x.source, x.node, x.depth) for x in got.where("source IN (0, 63, 64, 511, 512, 599)").collect()} == by_hand(links, [0, 63, 64, 511, 512, 599])
    assert sum(df.count() for name, df in made if name == "closure") < 600 * 600 / 10


def test_look_ups_and_sinks_move_little(spark, monkeypatch):
    """Look-ups of symbols read heads of chunks, without texts; a language's rows are dealt to several files."""
    from lexivault import queries

    assert "content" not in queries.indexed(spark, "/root/testdata/sf0.001", "chunk_heads").columns
    found = queries.QUERIES["sym_defs_wild"](spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "/index-chunks-" in f]
    made, real = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, name: made.append(df) or real(df, name))
    queries.QUERIES["sink_roundtrip"](spark, "/root/testdata/sf0.001")
    assert "hashpartitioning(language" in plan(made[0]) and "xxhash64" in plan(made[0])
    searcher = queries._searcher(spark, "/root/testdata/sf0.001", words=False)
    assert searcher.postings is None and searcher.stats is None


def test_sync_batches_of_several_files(spark, tmp_path):
    """A batch of many files is one state; the next call goes on from its checkpoint."""
    from lexivault.streaming.files import sync_stream

    kind, place = "path string, mtime double, size long", str(tmp_path)
    for n in range(2):
        spark.range(100).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit(float(n)).alias("mtime"), F.col("id").alias("size")).where(F.col("id") >= 50 * n).repartition(5).write.mode("append").parquet(f"{place}/in")
        last = sync_stream(spark.readStream.schema(kind).parquet(f"{place}/in"), f"{place}/out", f"{place}/state")
    assert last == 1
    rows = spark.read.parquet(f"{place}/out/{last}").collect()
    assert len(rows) == 100 and sorted(r.path for r in rows if r.mtime == 0.0) == sorted(f"p{k}" for k in range(50))


#: Rings of 6 nodes: 0 leads to 10 and 20, and both to 30; 50 leads into 0 and 35 out to 60.
RINGS = [(a + k, a + (k + 1) % 6) for a in (0, 10, 20, 30) for k in range(6)] + [(0, 10), (3, 20), (12, 30), (25, 31), (50, 2), (35, 60), (60, 61)]


@pytest.mark.parametrize("kind", ["rings", "random", "path", "none"])
def test_reach(spark, kind, monkeypatch):
    """With every pass that there is: pairs are those of a search by hand, each once."""
    r = random.Random(2)
    links = {"rings": RINGS * 2, "random": [(r.randrange(60), r.randrange(60)) for _ in range(80)] + [(None, 1), (1, None), (4, 4)], "path": [(k, k + 1) for k in range(6)], "none": []}[kind]
    sources = [50, 5, 2, 11, 24, 33, 34, 60, 99, 0, 0, None]
    monkeypatch.setattr(reaching, "LONGS", 0)
    got = reach(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(s,) for s in sources], "node long"))
    assert sorted((x.source, x.node) for x in got.collect()) == sorted((s, n) for s, n, _ in by_hand([x for x in links if x[0] is not None], sources))


def test_reach_splits_sources_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(reaching, "OWN", 4)
    links = [(k, (k * 3 + j) % 24) for k in range(24) for j in (1, 2)] + [(7, 100), (100, 101), (101, 100)]
    got = reach(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(s,) for s in range(103)], "node long"))
    assert sorted((x.source, x.node) for x in got.collect()) == sorted((s, n) for s, n, _ in by_hand(links, range(103)))


def test_graph_closure_walks_groups(spark, monkeypatch):
    """Nodes that reach each other go as one: nearly all of 2,000 parts do, and the walk has few rows."""
    made, real = [], catalog.stored
    monkeypatch.setattr(catalog, "stored", lambda df, name: made.append((name, df)) or real(df, name))
    QUERIES["graph_closure"](spark, "/root/testdata/sf0.01")
    assert 0 < sum(df.count() for name, df in made if name in ("closure", "reach")) < 200
