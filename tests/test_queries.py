"""Every query with SQL against that SQL, on the smallest corpus and the next."""

from __future__ import annotations

import pytest

from lexivault import engine_queries  # noqa: F401  adds its queries
from lexivault.queries import ORACLES, QUERIES

from .oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    n, m, different = compare(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.01")
    assert n == m and not different, different
    if name not in ("search_zero",):
        assert n > 0
