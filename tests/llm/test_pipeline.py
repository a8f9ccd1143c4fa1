from __future__ import annotations

from collections import Counter

import corpus_pipeline as C
from lexivault.llm import mixing
from lexivault.llm.jaccard_join import jaccard_components

from .test_jaccard_join import brute
from .test_packing import plain_ids


def kept(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in C.STAGES:
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{len(out)}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{len(out)}")
        out[name] = (before, docs)
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = out["language identification"]
    assert kept(after) <= kept(before) and after.count() == before.count()  # all of these are in a language
    before, after = out["n-gram Jaccard join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {i for (i, _), (_, _, c) in zip(sorted(rows, key=lambda r: repr(r[0])), brute(rows, 5, 80)) if repr(i) == c}
    before, after = out["mixing to target weights"]
    times = Counter(r.doc_id for r in after.collect())
    for r in mixing.mix(before).collect():
        assert times[r.doc_id] == -(-r.taken // r.size)
    before, after = out["packing"]
    ids = {r.doc_id: plain_ids(r.text) for r in before.collect()}
    assert sum(r.length for r in after.collect()) == sum(len(ids[r.doc_id]) for r in before.collect())


def test_run_is_the_stages(spark):
    rows = C.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_edges(spark, docs, no_docs):
    left = C.language_stage(spark, docs, "")
    assert left.columns == docs.columns and {r.n for r in left.collect()} == {1, 2, 5, 6, 8, 9, 10}
    once = C.near_duplicate_stage(spark, docs, "")
    assert once.columns == docs.columns
    assert Counter(r.doc_id for r in once.collect()) == Counter([0, 2, 3, 4, 5, None, 6, 7, 8, 9])
    again = spark.createDataFrame([(1, "a b c d e f g h", 1), (2, "a b c d e f g h", 2), (2, "other words that are not copied at all", 3), (3, "x", 4), (3, "x", 5), (3, "y", 6)], "doc_id long, text string, n int")
    left = sorted((r.doc_id, r.text) for r in C.near_duplicate_stage(spark, again, "").collect())
    assert left == [(1, "a b c d e f g h"), (2, "other words that are not copied at all"), (3, "x"), (3, "y")]
    mixed = C.mixing_stage(spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert jaccard_components(docs).count() == docs.count()
    for _, stage in C.STAGES:
        assert stage(spark, no_docs, "").collect() == []


def test_language_stage_is_more_than_letters(spark):
    """Runs in no language go although they have letters; languages that aren't wanted go too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    codes = ["deadbeef0123" * 40, "QWJjZGVm/+9kZmFzZGZhc2Rm" * 20, "short a1b2c3"]
    extra = spark.createDataFrame([(10_000 + k, t, None, "x", len(t)) for k, t in enumerate(codes)], docs.schema)
    left = C.language_stage(spark, docs.union(extra), "").select("doc_id").collect()
    ids = {r.doc_id for r in left}
    assert 10_000 not in ids and 10_001 not in ids and 10_002 in ids
    assert len(left) - 1 >= 0.998 * docs.count()
    assert extra.where("text rlike '[a-z]'").count() == 3
    C.LANGUAGES = ("en", "fr")
    try:
        some = C.language_stage(spark, docs, "").where("length(text) > 200").groupBy("lang").count().collect()
    finally:
        C.LANGUAGES = None
    n = {r.lang: r["count"] for r in some}
    assert n.get("en", 0) > 50 and n.get("de", 0) + n.get("es", 0) <= 0.02 * sum(n.values())


def test_columns_of_any_name_pass(spark):
    names = ["score", "lang_pred", "noise", "_text", "_words", "_times", "_doc_id", "_copy", "row", "slot", "hash", "c0", "r0"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wide = docs.selectExpr("*", *[f"doc_id * 100 + {k} as `{c}`" for k, c in enumerate(names)])
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[c] == r.doc_id * 100 + k for r in rows for k, c in enumerate(names))
    assert C.packing_stage(spark, wide, "").count() > 0
