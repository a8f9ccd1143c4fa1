from __future__ import annotations

import random

import pytest

from lexivault.llm._shared import connected_components


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_against_union_find(spark, kind):
    r = random.Random(4)
    n = 120
    edges = {"random": [(r.randrange(n), r.randrange(n)) for _ in range(80)], "path": [(k, k + 1) for k in range(60)], "star": [(100, k) for k in range(40)], "none": []}[kind]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = connected_components(spark.range(n).toDF("id"), spark.createDataFrame(edges, "a long, b long"))
    assert {x.id: x.component_id for x in got.collect()} == {k: find(k) for k in range(n)}
