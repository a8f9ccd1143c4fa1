from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexivault.llm import packing as P

PLAIN = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(alphabet="aàßéABCÉ 's123<|>end ftx \n\t.,!\x1c\x85\u0301İΣς日"))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(P.tokenizer(P.TOKENIZER).encode([text])[0], "<u2").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_long_words():
    t = P.WordTokenizer(public_tokenizers.path(P.TOKENIZER), most=20)
    texts = ["<|endoftext|> x<|startoftext|>", "a" * 5000, "don't WE'LL 'S ''", " ".join(f"w{k}" for k in range(100))] * 2
    assert [np.frombuffer(b, "<u2").tolist() for b in t.encode(texts)] == [PLAIN.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(t._held) <= 10 and t._quick is not None


def check(rows, want, window=4096):
    """Every id of every document in exactly one piece, sequences gapless and within the window."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for doc, parts in pieces.items():
        ids = want[doc]
        parts.sort(key=lambda r: r.start)
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))] and sum(p.length for p in parts) == len(ids)
        for p in parts:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert sum(p.length for p in parts) <= window
    return sequences


def test_query(spark):
    d = "/root/testdata/sf0.001"
    want = {r.doc_id: plain_ids(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sequences = check(P.op8_packing(spark, d).collect(), want)
    assert sum(sum(p.length for p in s) < 4096 for s in sequences.values()) <= 1


@pytest.mark.parametrize("shard", [50, 1000, 10**6])
def test_shards_and_windows(spark, shard):
    r = np.random.default_rng(shard)
    rows = [(k, " ".join(f"t{int(r.zipf(1.5)) % 50}" for _ in range(int(r.integers(0, 80)))), 1, 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, n int")
    want = {k: plain_ids(t) for k, t, *_ in rows}
    got = P.pack(df, window=32, shard_tokens=shard).collect()
    check(got, want, 32)
    assert sorted(map(repr, P.pack(df, window=32, shard_tokens=shard).collect())) == sorted(map(repr, got))
    ids = {(x.doc_id, x.start): np.frombuffer(bytes(x.ids), "<u4").tolist() for x in P.pack(df, window=32, shard_tokens=shard, with_ids=True).collect()}
    assert all(v == want[doc][s : s + len(v)] for (doc, s), v in ids.items())


def test_scores_are_bm25():
    docs = [np.array(x) for x in ([1, 1, 2], [1, 3], [3, 3, 3, 4], [5])]
    idf, mean = np.array([0, 0.5, 1.5, 0.7, 2.0, 1.0]), 2.5
    index = P.Index(docs, idf, mean)
    for q in range(4):
        for d in range(4):
            want = sum(idf[t] * (tf := (docs[d] == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t in set(docs[q].tolist()))
            assert index.scores(q)[d] == pytest.approx(want, rel=1e-5)


def test_neighbours_share_windows():
    """Documents on two topics: windows keep to one of them, but where it runs out."""
    r = np.random.default_rng(1)
    docs = [r.integers(10, 40, 10) + 100 * (k % 2) for k in range(40)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=200)
    pieces = P.pack_shard(docs, np.log1p((40 - df + 0.5) / (df + 0.5)), 10.0, 40)
    topics = defaultdict(set)
    for doc, _, _, sequence, _ in pieces:
        topics[sequence].add(doc % 2)
    assert sum(len(t) > 1 for t in topics.values()) <= 1


def test_edges(spark, docs, no_docs):
    rows = P.pack(docs).collect()
    assert sum(r.length for r in rows) == sum(len(plain_ids(r.text)) for r in docs.collect())
    assert [r.doc_tokens for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert sum(r.doc_id is None for r in rows) == 1
    assert P.pack(no_docs).collect() == []


def test_related_documents_share_shards(spark):
    """Documents of 20 topics, in 20 shards and more: nearly all of a document's neighbours are in its shard."""
    r = np.random.default_rng(3)
    rows = [(k, " ".join(f"{chr(97 + k % 20) * 3}{int(w)}" for w in r.integers(0, 60, 40))) for k in range(1000)]
    table = P.token_table(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", shard_tokens=8000)
    docs = table.where("df is null").select("doc_id", "leaf", "n").collect()
    leaves = defaultdict(int)
    for d in docs:
        leaves[d.leaf] += d.n
    places = {leaf: first for leaf, first, _ in P.shards_of(sorted(leaves.items()), 8000)}
    assert len(set(places.values())) >= 10
    topics = defaultdict(lambda: defaultdict(int))
    for d in docs:
        topics[d.doc_id % 20][places[d.leaf]] += 1
    together = sum(n * n for t in topics.values() for n in t.values()) / 20 / 50 / 50
    assert together > 0.4  # by chance it is one in the number of shards


def test_shards_hold_what_they_should():
    places = P.shards_of([(0, 40), (1, 50), (2, 30), (5, 250), (6, 10), (7, 100)], 100)
    assert places == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (5, 2, 3), (6, 5, 1), (7, 6, 1)]
    assert P.shards_of([], 100) == []


def test_short_neighbours_fill_the_window():
    """More neighbours than are tried at a time fit a window: it takes related ones on, not the next unread document."""
    r = np.random.default_rng(5)
    docs = [np.append(r.integers(10, 40, 3), 5) + 100 * (k % 2) for k in range(400)]  # a topic's documents share a term
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=200)
    pieces = P.pack_shard(docs, np.log1p((400 - df + 0.5) / (df + 0.5)), 4.0, 400)
    seen = defaultdict(set)
    for doc, _, _, sequence, _ in pieces:
        seen[sequence].add(doc % 2)
    assert sum(len(t) > 1 for t in seen.values()) <= 1


def test_all_terms_are_queried():
    """A document that shares only a light term of a long seed has a score."""
    docs = [np.arange(1, 60), np.array([59, 70]), np.array([80])]
    idf = np.ones(100)
    idf[59] = 0.01
    index = P.Index(docs, idf, 20.0)
    assert index.scores(0)[1] > 0 and index.scores(0)[2] == 0


def plain_pack(docs, idf, mean, window):
    """The filling by its words: one document after another, scores made anew for each, in exact order of rank."""
    left, pieces, sequence, filled = list(range(len(docs))), [], 0, 0

    def put(doc):
        nonlocal sequence, filled
        at = 0
        while at < len(docs[doc]):
            n = min(window - filled, len(docs[doc]) - at)
            pieces.append((doc, at, n, sequence, filled))
            at, filled = at + n, filled + n
            if filled == window:
                sequence, filled = sequence + 1, 0
        left.remove(doc)

    def score(q, d):
        total = np.float64(0)
        for t in sorted(set(docs[q].tolist())):
            tf = int((docs[d] == t).sum())
            if tf:
                total += np.float32(idf[t] * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * len(docs[d]) / mean)))
        return total

    seed = None
    while left:
        if not filled:
            seed = left[0]
            put(seed)
            continue
        ranked = sorted((d for d in left if score(seed, d) > 0), key=lambda d: (-score(seed, d), d))
        best = None
        while filled and best is None and ranked:
            some, ranked = ranked[: P.NEIGHBOURS], ranked[P.NEIGHBOURS :]
            for d in some:
                if filled and len(docs[d]) <= window - filled:
                    put(d)
            best = next((d for d in some if d in left), None)
        if filled and left:
            seed = left[0] if best is None else best
            put(seed)
    return pieces


@pytest.mark.parametrize("seed", range(5))
def test_filling_against_a_plain_one(seed, monkeypatch):
    monkeypatch.setattr(P, "NEIGHBOURS", 6)
    monkeypatch.setattr(P, "OFTEN", 2.0)  # all terms by postings: sums in the order of terms
    r = np.random.default_rng(seed)
    docs = [r.integers(0, 40, int(r.integers(1, 30))) + (40 * int(r.integers(0, 3)) if r.random() < 0.8 else 0) for _ in range(70)]
    idf = r.uniform(0.1, 5, 200)
    assert P.pack_shard(docs, idf, 14.0, 64) == plain_pack(docs, idf, 14.0, 64)


def test_shards_of_short_documents_are_bounded(spark):
    """Many documents of two tokens: shards are filled by documents, not by tokens alone."""
    rows = spark.range(3000).selectExpr("id as doc_id", "concat('w', id % 97) as text")
    got = P.pack(rows, shard_tokens=128 * 500).collect()
    per = defaultdict(int)
    for x in got:
        per[x.sequence_id >> 32] += x.start == 0
    assert sum(per.values()) == 3000 and max(per.values()) <= 500


def test_filling_lets_go_of_the_tokenizers_memory():
    """A Python worker that has tokenized fills windows next: the words it held aren't kept beside the index."""
    import subprocess
    import sys

    code = """
import lexivault.llm.packing as P
def held():
    return int(next(l for l in open("/proc/self/status") if l.startswith("VmRSS")).split()[1]) >> 10
t = P.tokenizer(P.TOKENIZER)
begin = held()
t.encode([" ".join(f"w{i:x}q" for i in range(300_000))])
del t
full = held()
P.let_go()
print(begin, full, held(), len(P._loaded))
"""
    begin, full, left, loaded = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert loaded == 0 and full - begin > 30 and full - left > (full - begin) * 0.7, (begin, full, left)


def test_an_index_beyond_32_bits_of_document_and_id():
    """Documents times ids are numbered in 32 bits only where these hold them."""
    docs = [np.array([d % 7, 49_151, d % 5], dtype=np.uint16) for d in range(90_000)]
    index = P.Index(docs, np.ones(49_152), 3.0)
    for d in (0, 1, 87_380, 87_381, 87_382, 89_999):
        assert index.token[index.of[d] : index.of[d + 1]].tolist() == sorted(set(docs[d].tolist()))


ALPHABET = "aàßéABCÉ 's123<|>end ftxreLvm \n\t.,!\x01\x02\x1c\x85\xa0\u2003\u3000\u0301\xb5İΣς日😀’"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text() | st.text(alphabet=ALPHABET) | st.text(alphabet="a1s'tre!vldm T"), max_size=6))
def test_ids_of_many_texts_at_once_are_the_tokenizers(texts):
    got = [np.frombuffer(b, "<u2").tolist() for b in P.tokenizer(P.TOKENIZER).encode_all(texts)]
    assert got == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_texts_at_once_with_strange_words_and_specials():
    t = P.WordTokenizer(public_tokenizers.path(P.TOKENIZER), most=20)
    texts = ["", "<|endoftext|> x<|startoftext|>", "a" * 5000, "don't WE'LL 'S '' it's'sandwich !'s 1're", "\x01 \x02 x", "日本 don’t stop", "\x1ca b", "", "a\x85b\xa0c\u2003d\u3000e"]
    texts += [*map(chr, range(0x3100))] + [f"a{chr(c)}b" for c in range(0x3100)]
    assert [np.frombuffer(b, "<u2").tolist() for b in t.encode_all(texts)] == [PLAIN.encode(x, add_special_tokens=False).ids for x in texts]
    assert t.encode_all([]) == []


def test_plain_words_are_not_made_one_by_one(monkeypatch):
    """Words that missed the cache were made one by one in Python, half of the time that ids took."""
    t = P.WordTokenizer(public_tokenizers.path(P.TOKENIZER))
    made = []
    monkeypatch.setattr(t._held, "make", lambda word: made.append(word) or t._direct(word))
    texts = [" ".join(f"w{k:x}q, it's" for k in range(2000)), "one ’strange’ word"]
    assert [np.frombuffer(b, "<u2").tolist() for b in t.encode_all(texts)] == [PLAIN.encode(x, add_special_tokens=False).ids for x in texts]
    assert made == ["’strange’"]
