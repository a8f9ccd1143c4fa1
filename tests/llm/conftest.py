from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls in every column, empty and long texts, ties, repeats, and columns whose names clash with those that
    operators use."""
    long = " ".join(f"word{k % 977} the license" for k in range(30_000))
    rows = [
        (0, "the quick brown fox jumps over the lazy dog", "en", "a", 44, 1),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 44, 2),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 44, 2),
        (2, None, "en", "b", None, 3),
        (3, "", None, None, 0, None),
        (4, "   \t\n ", "fr", "", 6, 4),
        (5, long, "en", "b", len(long), 5),
        (None, "une phrase sans numéro", "fr", "a", 22, 6),
        (6, "1234 5678 !!", "de", "b", 12, 7),
        (7, "Ünïcödé 日本語 \U0001f600 wörter", "de", None, 20, 8),
        (8, "one", "en", "a", 3, 9),
        (9, "one two", "en", "z", 7, 10),
    ]
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n long, key string, size int, row string, tokens string")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
