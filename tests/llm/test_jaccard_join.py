from __future__ import annotations

import re

import numpy as np
import pytest

from lexivault.llm import jaccard_join as J


def word_sets(rows, k):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        out.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, k, num, den=100):
    """``(doc_id, n_shingles, component_id)`` of rows with distinct or null ids."""
    sets = word_sets(rows, k)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    rank = {i: r for r, i in enumerate(order)}
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                n = len(sets[a] & sets[b])
                if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                    p, q = find(a), find(b)
                    lo, hi = (p, q) if rank[p] < rank[q] else (q, p)
                    root[hi] = lo
    return sorted((repr(i), len(s), repr(rows[find(k_)][0])) for k_, ((i, _), s) in enumerate(zip(rows, sets)))


def got(df):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in df.collect())


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_query_against_brute_force(spark, k, num):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(J.jaccard_components(spark.read.parquet(f"{d}/documents.parquet"), k=k, num=num)) == brute(rows, k, num)


def families(seed):
    """Near copies at all distances around the bound, sharing passages, with chains of small steps."""
    r = np.random.default_rng(seed)
    word = lambda: f"w{int(r.zipf(1.3)) % 400}"
    rows, common = [], [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(int(r.integers(1, 90)))] + (common if r.random() < 0.3 else [])
        for _ in range(int(r.integers(1, 6))):
            rows.append((len(rows), " ".join(base)))
            base = list(base)
            for _ in range(int(r.integers(0, 4))):
                base[int(r.integers(0, len(base)))] = word()
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_around_the_bound(spark, seed, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_TOKENS", 500)  # chains larger than that are cut into blocks
    monkeypatch.setattr(J, "BLOCK_SETS", 5)
    rows = families(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.jaccard_components(df, k=3, num=90)) == brute(rows, 3, 90)
    assert got(J.jaccard_components(df, k=3, num=60)) == brute(rows, 3, 60)


def test_edges(spark, docs, no_docs):
    rows = J.jaccard_components(docs, k=3, num=90).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert [r.component_id for r in rows if r.doc_id == 1] == [0, 0]
    assert (by[2].n_shingles, by[2].component_id) == (0, 2) and by[4].n_shingles == 0
    assert (by[None].n_shingles, by[None].component_id) == (2, None)
    assert (by[8].n_shingles, by[9].n_shingles, by[9].component_id) == (1, 1, 9)
    assert J.jaccard_components(no_docs).collect() == []


def test_repeated_ids_with_other_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (3, "x y z x y z")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.component_id) for r in J.jaccard_components(df, k=3, num=90).collect())
    assert rows == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_repeated_ids_dont_join_their_texts(spark):
    """A repeated id's texts are sets of their own: what links with one isn't linked with the other."""
    a, b = "a b c d e f g h i j k l m n o p", "q r s t u v w x y z q s u w y"
    df = spark.createDataFrame([(5, a), (3, a + " q"), (5, b), (9, b + " t"), (9, b + " t")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.component_id) for r in J.jaccard_components(df, k=1, num=60).collect())
    assert rows == [(3, 3), (5, 3), (5, 5), (9, 5), (9, 5)]


def test_oracle(spark):
    from tests.oracle import compare

    n, m, different = compare(spark, J.op6_jaccard_join, J.ORACLE, "/root/testdata/sf0.01")
    assert n == m > 0 and not different


def test_a_family_of_many_groups_and_its_strays(spark, monkeypatch):
    """More than a thousand groups share a token; near copies, copies of copies and texts that only share a passage."""
    monkeypatch.setattr(J, "BLOCK_SETS", 64)
    r = np.random.default_rng(3)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for k in range(1200):
        if k % 3 == 0:  # a passage of the family in a text of another kind
            words = [*base[:10], *[f"u{k}_{j}" for j in range(12)]]
        else:
            words = list(base)
            words[int(r.integers(0, 40))] = f"e{k}"
            if k % 7 == 0:
                words += [f"x{k % 21}_{j}" for j in range(9)]
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(J.jaccard_components(df, k=1, num=80)) == brute(rows, 1, 80)


@pytest.mark.parametrize("seed", range(4))
def test_links_of_a_task(seed):
    """Queries against targets, with known components, by the matrix and pair by pair."""
    r = np.random.default_rng(seed)
    bases = [r.permutation(300)[:30] for _ in range(5)]
    sets = []
    for _ in range(60):
        s = bases[int(r.integers(0, 5))].copy()
        s[: int(r.integers(0, 5))] = r.integers(300, 330, 1)
        sets.append(np.unique(s).astype(np.uint64))
    m = len(sets)
    group = r.integers(0, 12, m)
    query, target = r.random(m) < 0.5, r.random(m) < 0.7
    known = np.arange(m)
    known[m // 2 + 1] = known[m // 2]
    label = J.link_sets(sets, group, known, query, target, 80, 100)
    root = known.copy()
    for i in range(m):
        for j in range(m):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if query[i] and target[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[root == root[j]] = root[i]
    assert (np.equal.outer(label, label) == np.equal.outer(root, root)).all()


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingle_hashes_tell_sets_apart(k):
    texts = ["", " ", "a", "a b", "a b c a b c a b c", "A\tb\nc\x0bd\x0ce", "\xa0 é ü " + "x" * 50, "one " * 100, "日本 語 " * 7]
    sets = word_sets([(0, t) for t in texts], k)
    assert [len(J.shingles(J.word_hashes(t.encode()), k)) for t in texts] == [len(s) for s in sets]


def test_long_texts_are_hashed_in_segments(monkeypatch):
    text = (" ".join(f"w{n}" for n in range(500)) + " " + "y" * 300 + " end").encode()
    whole = J.word_hashes(text)
    monkeypatch.setattr(J, "SEGMENT", 64)
    assert (J.word_hashes(text) == whole).all() and len(whole) == 502


def test_prefix_bound_is_safe():
    """Similar sets share as many tokens of their prefixes as is asked for, whatever the order."""
    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(1, 60))
        a = set(r.permutation(1000)[:n].tolist())
        b = set(a)
        for _ in range(int(r.integers(0, 8))):
            b.discard(next(iter(b), None)) if r.random() < 0.5 else b.add(int(r.integers(1000, 1100)))
        num, den = 80, 100
        both = len(a & b)
        if b and den * both >= num * (len(a) + len(b) - both):
            order = {t: k for k, t in enumerate(r.permutation(1100).tolist())}
            head = lambda s: set(sorted(s, key=order.get)[: int(J.prefix_length(len(s), num, den))])
            assert len(head(a) & head(b)) >= min(J.DEPTH, -(-max(len(a), len(b)) * num // den))


def test_tokens_of_many_groups_cost_a_row_a_group():
    """Groups that share a token of many are chained through its first; few are counted for each two."""
    import pyarrow as pa

    many, few = 3 * J.SHARED, 5
    rows = [(1, g) for g in range(many)] + [(t, 1000 + g) for t in (2, 3) for g in range(few)] + [(4, 7), (5, 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in ([t for t, _ in rows], [g for _, g in rows], *[[v] * len(rows) for v in (50, 50, 90, 100)])], names=["token", "g", "lo", "hi", "num", "den"])
    got = {(a, b): c for out in J._open_groups(iter([batch])) for a, b, c in zip(*(out.column(k).to_pylist() for k in ("a", "b", "c")))}
    assert {k: v for k, v in got.items() if k[0] < 1000} == {(0, g): J.DEPTH for g in range(1, many)}
    assert {k: v for k, v in got.items() if k[0] >= 1000} == {(1000 + a, 1000 + b): 2 for a in range(few) for b in range(a + 1, few)}


@pytest.mark.parametrize(("k", "num", "vocabulary"), [(3, 90, 32), (5, 80, 8)])
def test_prefixes_hold_the_rarest_words(spark, monkeypatch, k, num, vocabulary):
    """Runs of frequent words that are too rare to be counted themselves: texts that share them aren't opened for one
    another where they have words of their own."""
    r = np.random.default_rng(9)
    rows = [(i, " ".join([f"c{v}" for v in r.integers(0, vocabulary, 200)] + [f"u{i}_{j}" for j in range(70)])) for i in range(200)]
    rows.append((200, rows[7][1] + " more"))
    made, stored = {}, J.stored
    monkeypatch.setattr(J, "stored", lambda df, name: made.setdefault(name, stored(df, name)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(x, y) for x, _, y in got(J.jaccard_components(df, k=k, num=num)) if x != y] == [("200", "7")]
    shared = made["jaccard-sets"].where("doc_id < 200").selectExpr("explode(prefix) as token").groupBy("token").count().where("count > 1")
    assert shared.count() == 0
    assert made["jaccard-open"].count() <= 1


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_passages_of_many_texts_dont_chain_them(spark, monkeypatch, k, num):
    """Passages that more than ``SHARED`` groups hold, of words too rare to be counted: a sample of the tokens finds them."""
    monkeypatch.setattr(J, "MOST_HEAVY", 1)
    r = np.random.default_rng(10)
    passages = [" ".join(f"p{v}_{j}" for j in range(40)) for v in range(5)]
    rows = [(i, " ".join([passages[i % 5], *(f"u{i}_{j}" for j in range(80)), passages[int(r.integers(5))]])) for i in range(800)]
    rows.append((800, rows[7][1] + " more"))
    made, stored = {}, J.stored
    monkeypatch.setattr(J, "stored", lambda df, name: made.setdefault(name, stored(df, name)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(x, y) for x, _, y in got(J.jaccard_components(df, k=k, num=num)) if x != y] == [("800", "7")]
    assert made["jaccard-open"].count() <= 1


def test_first_tokens_put_frequent_ones_last_by_their_count():
    r = np.random.default_rng(11)
    for _ in range(50):
        s = np.unique(r.integers(0, 1 << 64, int(r.integers(1, 60)), dtype=np.uint64))
        level = r.integers(0, 3, len(s))
        hot = np.unique(np.concatenate([(s[r.random(len(s)) < 0.5] >> np.uint64(32)).astype(np.uint32), np.arange(5, dtype=np.uint32)]))
        times = r.integers(3, 6, len(hot))
        count = dict(zip(hot.tolist(), times.tolist()))
        order = sorted(range(len(s)), key=lambda i: (count.get(int(s[i]) >> 32, 0), 0 if int(s[i]) >> 32 in count else level[i], int(s[i])))
        most = int(r.integers(1, len(s) + 1))
        assert J.first_tokens(s, level, hot, times, most).tolist() == s[order][:most].tolist()
