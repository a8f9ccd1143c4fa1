"""Tokens against those of SQLite's full-text index, which the index's are to equal."""

from __future__ import annotations

import random
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexivault.functions.text import query_tokens, tokens

OLD = unicodedata.ucd_3_2_0


def theirs(texts):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(texts))
    out = [[] for _ in texts]
    for term, doc in con.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        out[doc].append(term)
    return out


def ours(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, x string").select("id", tokens(F.col("x")).alias("t")).collect()
    found = {r.id: r.t for r in rows}
    return [found[k] for k in range(len(texts))]


def agree(spark, texts):
    expected = theirs(texts)
    for text, a, b, c in zip(texts, expected, ours(spark, texts), map(query_tokens, texts)):
        assert a == b == c, (text, a, b, c)


NAMED = ["cafés", "café", "İstanbul", "istanbul ısı IŞIK", "ộ ǖ Ộ Ǖ", "ΣΣ ΟΔΟΣ ὀδός Ὀδυσσεύς", "ſtop", "straße STRASSE ẞ", "Ångström Ångström", "́start a ́b x̅y z̸", "naïve-coöperate", "đường phố Hà Nội", "Nội".encode().decode(), "ﬁnal ﬂow", "Ёлка ёлка ЙОД й", "ÅÄÖ åäö ø Ø ł Ł", "x­z a‍b", "1½ ² Ⅳ ٣", "日本語 한국어 ไทย हिन्दी", "\U00010400\U00010428", "µ μ Ω Ω K", ""]


def test_named(spark):
    agree(spark, NAMED + [unicodedata.normalize(form, t) for form in ("NFC", "NFD", "NFKD") for t in NAMED])


def test_every_code_point(spark):
    """Each that Unicode 3.2 knows, within a token and alone: SQLite's tables are older than Java's, and characters that
    only the latter know may part tokens in the one and not in the other."""
    points = [c for c in map(chr, range(0x80, 0x20000)) if OLD.category(c) not in ("Cn", "Cs") and not "Ꭰ" <= c <= "Ᏽ"]
    some = [c for c in points if OLD.category(c) == unicodedata.category(c)]
    agree(spark, [f"x{c}Y {c}" for c in some])


@pytest.mark.parametrize("seed", range(4))
def test_mixed(spark, seed):
    r = random.Random(seed)
    alphabets = ["abcXYZ ̣́̈̂", "ıİiIşŞğĞçÇöÖüÜ ", "ăâđêôơưẠạẢảẤấộỘựỰ ̣̂", "αβγΣσςΆέΏ ́̓ͅ", "äöüßÄÖÜẞſ-_.", "йёЙЁ̆̈ъ ", "日本 1²½"]
    texts = ["".join(r.choices("".join(r.sample(alphabets, r.choice([1, 2, 3]))), k=r.randrange(1, 60))) for _ in range(1500)]
    agree(spark, texts + [unicodedata.normalize("NFD", t) for t in texts])
