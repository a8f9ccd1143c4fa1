"""Nested ignore files over a table of paths, against the walker's rules for each path by itself."""

from __future__ import annotations

import random

import pytest

from lexivault.operators.ignores import visible
from lexivault.sources.walk import _Ignore


def seen(path, files):
    """Whether a walk reaches the path: no folder on its way, nor itself, is hidden by an ignore file above it."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        entry = "/".join(parts[:k])
        above = ["/".join(parts[:j]) for j in range(k)]
        if any(_Ignore(f, files[f]).hides(entry, k < len(parts)) for f in above if f in files):
            return False
    return True


LINES = ["*.py", "!a.py", "b/", "/a", "a/b", "**/c", "c/**", "!c", "*", "!*/", "[ab].txt", "# no", "", "d?", "!d1/", "a.py "]


@pytest.mark.parametrize("seed", range(3))
def test_visible(spark, seed):
    r = random.Random(seed)
    folders = ["", "a", "b", "a/b", "a/c", "b/d1", "a/b/c"]
    files = {f: r.choices(LINES, k=r.randrange(1, 5)) for f in r.sample(folders, 5)}
    paths = sorted({"/".join([*r.choices(["a", "b", "c", "d1", "d2"], k=r.randrange(0, 4)), r.choice(["a.py", "b.py", "a.txt", "c", "d1"])]) for _ in range(300)})
    rules = spark.createDataFrame([(f, n, line) for f, lines in files.items() for n, line in enumerate(lines)], "folder string, place int, line string")
    given = spark.createDataFrame([(p, 1) for p in paths] + [(None, 1), (paths[0], 2)], "path string, entry int")
    got = visible(given, rules).collect()
    assert sorted(repr(tuple(g)) for g in got) == sorted(repr(p) for p in [(p, 1) for p in paths if seen(p, files)] + [(None, 1)] + [(paths[0], 2)] * seen(paths[0], files))


def test_none(spark):
    rules = spark.createDataFrame([("", 1, None), (None, 2, "*.x")], "folder string, place int, line string")
    paths = spark.createDataFrame([("a.x",), ("b/a.x",), ("b/a.y",), ("",)], "path string")
    assert sorted(r.path for r in visible(paths, rules).collect()) == ["", "b/a.y"]
    assert visible(paths.limit(0), rules).collect() == [] and visible(paths, rules.limit(0)).count() == 4
