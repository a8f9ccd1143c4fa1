"""An index of segments against one built anew after every change."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexivault.operators import lexical
from lexivault.operators.blocks import BlockIndex, top_batch, top_query
from lexivault.plans import segments
from lexivault.plans.segments import SegmentStore, level

KIND = "id long, path string, name string, scope string, content string"
WORDS = ["the", "license", "apache", "a", "b", "c", "rare", "word", "café"]


def rows_of(index, words, k=15, every=False):
    return [(r.id, round(r.score, 9), r.rank) for r in top_query(index, words, k, every).orderBy("rank").collect()]


def anew(spark, state):
    chunks = spark.createDataFrame(list(state), KIND)
    return chunks, BlockIndex.of(lexical.postings(chunks), lexical.corpus_stats(chunks)).stored()


def same(spark, store, state, version=None):
    """Chunks, statistics, dictionary and searches of all kinds."""
    _, whole = anew(spark, state)
    mine = store.index(version)
    assert sorted(tuple(r) for r in store.chunks(version).select("id", "path", "name", "scope", "content").collect()) == sorted(state)
    a, b = mine.stats.first(), whole.stats.first()
    assert a.n == b.n and (a.avgdl is None and not b.avgdl or a.avgdl == pytest.approx(b.avgdl))
    docs = lambda i: {r.term: r.docs for r in i.dictionary.collect()}
    assert docs(mine) == docs(whole)
    for words, every in ((["the"], False), (["license", "apache"], False), (["the", "a"], True), (["rare", "cafe", "x7"], False)):
        assert rows_of(mine, words, every=every) == rows_of(whole, words, every=every)
    asked = spark.createDataFrame([(q, w) for q in range(4) for w in WORDS[q :: 3]], "query int, term string")
    batch = lambda i: sorted((r.query, r.rank, r.id, round(r.score, 9)) for r in top_batch(i, asked, 6).collect())
    assert batch(mine) == batch(whole)


def made(r, ident, path):
    return (ident, path, r.choice([None, "name", "the"]), None, " ".join(r.choices([*WORDS, f"x{ident % 11}"], weights=[9, 4, 3, 5, 2, 2, 1, 2, 1, 2], k=r.choice([0, 1, 5, 30]))))


def test_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FANOUT", 3)
    r = random.Random(11)
    store = SegmentStore(spark, str(tmp_path / "index"))
    assert store.versions() == [] and store.chunks().collect() == [] and rows_of(store.index(), ["the"]) == []
    state: dict[int, tuple] = {}
    for step in range(5):
        paths = [f"p{r.randrange(60)}" for _ in range([90, 6, 4, 0, 5][step])]
        gone = sorted({f"p{r.randrange(70)}" for _ in range([0, 3, 2, 4, 0][step])})
        first = store.next_id()
        new = [made(r, first + k, p) for k, p in enumerate(paths)]
        if step == 4:
            store.compact()
            assert sum(p.kind == "segment" for p in store.manifest()[1]) < 3
        before = store.chunks().collect()
        version = store.change(spark.createDataFrame(new, KIND).repartition(2), spark.createDataFrame([(g,) for g in gone * 2], "path string") if gone else None)
        taken = {x[0] for x in state.values() if x[1] in {*paths, *gone}}
        state = {k: v for k, v in state.items() if k not in taken} | {n[0]: n for n in new}
        # what the change wrote: its own chunks, and a tombstone for each that it took out
        parts = [p for p in store.manifest()[1] if p.change.startswith(f"{version:09d}")]
        assert sum(p.rows for p in parts if p.kind == "segment") == len(new) and sum(p.rows for p in parts if p.kind == "dead") == len(taken)
        if step in (3, 4):
            same(spark, store, state.values())
        # the version before is as it was
        assert sorted(map(str, store.chunks(version - 1).collect())) == sorted(map(str, before)) if version > 1 else not before
    assert store.next_id() > max(state)


def test_unlisted(spark, tmp_path):
    """What a change wrote that failed before its commit is seen by nobody, and a later change isn't hurt."""
    store = SegmentStore(spark, str(tmp_path / "index"))
    r = random.Random(2)
    state = [made(r, k, f"p{k % 7}") for k in range(1, 30)]
    store.change(spark.createDataFrame(state, KIND))

    class Stop(Exception):
        pass

    def commit(*_):
        raise Stop

    keep, store._commit = store._commit, commit
    with pytest.raises(Stop):
        store.change(spark.createDataFrame([made(r, 50, "p1")], KIND), spark.createDataFrame([("p2",)], "path string"))
    store._commit = keep
    same(spark, store, state)
    new = made(r, 51, "p3")
    store.change(spark.createDataFrame([new], KIND))
    same(spark, store, [s for s in state if s[1] != "p3"] + [new])


def test_all_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FANOUT", 2)
    store = SegmentStore(spark, str(tmp_path / "index"))
    for k in (1, 2):
        store.change(spark.createDataFrame([(k, f"p{k}", None, None, "the word")], KIND))
    store.change(spark.createDataFrame([], KIND), spark.createDataFrame([("p1",), ("p2",), (None,)], "path string"))
    assert store.chunks().collect() == [] and rows_of(store.index(), ["the"]) == [] and store.next_id() == 3
    store.compact()
    assert store.chunks().collect() == [] and store.next_id() == 3
    store.change(spark.createDataFrame([(3, "p1", None, None, "the word")], KIND))
    assert [x[0] for x in rows_of(store.index(), ["the"])] == [3]


def test_levels():
    assert [level(n) for n in (0, 1, 999, 1000, 3999, 4000, 15999, 16000)] == [0, 0, 0, 1, 1, 2, 2, 3]


def test_only_changed_parts_are_read(spark, tmp_path):
    """A change reads the parts of the chunk table in which its paths lie."""
    store = SegmentStore(spark, str(tmp_path / "index"))
    store.change(spark.createDataFrame([(k, f"p{k}", None, None, "a word") for k in range(1, 200)], KIND))
    _, parts = store.manifest()
    shards = [r.shard for r in spark.createDataFrame([("p5",)], "path string").select(segments._shard().alias("shard")).collect()]
    rows = store._live(parts).where(F.col("shard").isin(shards))
    assert 0 < len(rows.inputFiles()) and "PartitionFilters: [" in rows._jdf.queryExecution().executedPlan().toString() and "shard" in rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:300]
