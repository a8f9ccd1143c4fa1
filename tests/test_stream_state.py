"""Changes of files from a stream, against the same history in order."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexivault.streaming import state
from lexivault.streaming.state import status

KIND = "path string, mtime double, size long, gone boolean, at timestamp"
START = datetime(2024, 3, 1)


def at(hours):
    return START + timedelta(hours=hours)


def by_hand(batches, late_hours):
    """Changes that are settled after these batches, by the rules: what is late goes, the rest in order of its times."""
    newest, kept = None, []
    for batch in batches:
        rows = [b for b in batch if None not in (b[0], b[3], b[4]) and (b[3] or None not in b[1:3])]
        kept += [b for b in rows if newest is None or b[4] > newest - timedelta(hours=late_hours)]
        newest = max([b[4] for b in batch if b[4]] + ([newest] if newest else []))
    out, last = [], {}
    for path, mtime, size, gone, when in sorted((b[0], 0.0 if b[3] else b[1], 0 if b[3] else b[2], b[3], b[4]) for b in kept if b[4] <= newest - timedelta(hours=late_hours)):
        out.append((when, path, (mtime, size, gone)))
    found = []
    for when, path, now in sorted(out, key=lambda o: (o[0], o[1], o[2])):
        if change := status(last.get(path), now):
            found.append((path, change, now[0], now[1], when))
        last[path] = now
    return sorted(found)


BATCHES = [
    [("a", 1.0, 5, False, at(0)), ("a", 1.0, 5, False, at(1)), ("b", 1.0, 1, False, at(10)), ("a", 2.0, 5, False, at(3)), ("c", None, None, True, at(2)), ("d", 1.0, 1, False, at(9))],
    # out of order but in time; a repeat; gone and back; without a path or a time
    [("a", 1.5, 5, False, at(7)), ("b", 1.0, 1, False, at(10)), ("a", None, None, True, at(8)), ("a", 3.0, 7, False, at(20)), (None, 1.0, 1, False, at(6)), ("d", 2.0, 2, False, None), ("d", None, 4, False, at(12))],
    # too late: the newest is 20 hours, and 5 of them may pass
    [("a", 9.0, 9, False, at(14)), ("b", 9.0, 9, False, at(4)), ("b", None, None, True, at(16)), ("e", 1.0, 1, False, at(15)), ("e", 2.0, 1, False, at(15.5)), ("d", 2.0, 2, False, at(30))],
    [("b", 4.0, 4, False, at(31)), ("b", 4.0, 4, False, at(31)), ("e", None, None, True, at(50))],
]


def test_batches_and_restarts(spark, tmp_path):
    """Each call is a query of its own that goes on from the checkpoint; the output so far is settled for good."""
    source, out, kept = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for n, batch in enumerate(BATCHES, 1):
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(source)
        state.follow(spark.readStream.schema(KIND).parquet(source), out, kept, "5 hours")
        got = sorted(tuple(r) for r in spark.read.schema(state.CHANGES).parquet(out).collect())
        assert got == by_hand(BATCHES[:n], 5), n
    # nothing new: nothing is put out again
    state.follow(spark.readStream.schema(KIND).parquet(source), out, kept, "5 hours")
    assert spark.read.parquet(out).count() == len(got) > 8
    assert spark.conf.get(state.PROVIDER, "") != state.ROCKS


@pytest.mark.parametrize(("before", "now", "expected"), [(None, (1.0, 2, False), "added"), (None, (0.0, 0, True), None), ((1.0, 2, False), (1.0, 2, False), None), ((1.0, 2, False), (1.0, 3, False), "changed"), ((1.0, 2, False), (0.0, 0, True), "removed"), ((0.0, 0, True), (0.0, 0, True), None), ((0.0, 0, True), (1.0, 2, False), "added")])
def test_status(before, now, expected):
    assert status(before, now) == expected


def test_a_failed_batch_is_written_once(spark, tmp_path, monkeypatch):
    """A batch that has written its changes and then fails is taken in again, and its changes come once."""
    source, out, kept = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    stream = lambda: spark.readStream.schema(KIND).parquet(source)
    spark.createDataFrame(BATCHES[0], KIND).coalesce(1).write.parquet(source)
    real, calls = state._steps, []

    def failing(due):
        calls.append(1)
        if len(calls) == 1:
            real(due).where("status IS NOT NULL").select("path", "status", "mtime", "size", F.timestamp_millis("at_ms").alias("at")).write.parquet(f"{kept}/changes/0")
            raise RuntimeError("lost")
        return real(due)

    monkeypatch.setattr(state, "_steps", failing)
    with pytest.raises(Exception, match="lost"):
        state.follow(stream(), out, kept, "5 hours")
    state.follow(stream(), out, kept, "5 hours")
    assert sorted(tuple(r) for r in spark.read.schema(state.CHANGES).parquet(out).collect()) == by_hand(BATCHES[:1], 5)


def test_no_state_store_for_each_path(spark, tmp_path, monkeypatch):
    """``follow`` makes no call between Spark and Python for a path; a stream without a file gives nothing."""
    source, out, kept = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    monkeypatch.setattr(state, "file_changes", lambda *a: pytest.fail("a store for each path"))
    spark.createDataFrame([], KIND).write.parquet(source)
    state.follow(spark.readStream.schema(KIND).parquet(source), out, kept, "5 hours")
    spark.createDataFrame([("p%d" % (k % 500), 1.0, k // 500, False, at(k)) for k in range(2000)], KIND).write.mode("append").parquet(source)
    state.follow(spark.readStream.schema(KIND).parquet(source), out, kept, "5 hours")
    assert spark.read.parquet(out).count() == 1995
