"""Changes of files from a stream of observations, by state that is kept for each path.

An observation says that a file was seen with a time and size, or that it is gone, and when that was. Observations come late,
twice and out of order. Each path's wait until the watermark has passed them; then they are applied in the order
of their event times, and what differs from the path's last state is put out: ``added``, ``changed`` or ``removed``. So the
output is that of the whole history in order, however the stream was cut into batches, but for observations that came
when the watermark had passed them, which count nowhere. Output is only ever appended, and a query that is started
again goes on from its checkpoint.

``follow`` takes in what a stream holds, with the state in tables. ``file_changes`` is for queries that stay up: state in each
path's own store, and a few calls between Spark and Python for every path that a batch meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

from ..runtime import ship
from .files import append_to_table

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "path string, status string, mtime double, size long, at timestamp"
_SEEN = "mtime double, size long, gone boolean"
_HELD = f"path string, at_ms long, {_SEEN}"


def status(before: tuple | None, now: tuple) -> str | None:
    """What an observation ``(mtime, size, gone)`` is after the last one, None for the first; None if nothing changed."""
    was = before is not None and not before[2]
    if now[2]:
        return "removed" if was else None
    return "added" if not was else "changed" if before[:2] != now[:2] else None


class Follow(StatefulProcessor):
    """State of a path: its last observation, and those that wait, with a timer for the first of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _SEEN)
        self.waiting = handle.getListState("waiting", f"at_ms long, {_SEEN}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            new = [(int(at), float(m), int(s), bool(g)) for at, m, s, g in zip(part["at_ms"], part["mtime"], part["size"], part["gone"])]
            if new:
                self.waiting.appendList(new)
                first = min([n[0] for n in new] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(w) for w in self.waiting.get())
        due, rest = [w for w in held if w[0] <= passed], [w for w in held if w[0] > passed]
        if not due:
            return
        before = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for at, *now in due:
            found = status(before, tuple(now))
            if found:
                out.append((key[0], found, *now[:2], at))
            before = tuple(now)
        self.last.update(before)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.waiting.clear()
        if out:
            made = pd.DataFrame(out, columns=["path", "status", "mtime", "size", "at"])
            made["at"] = pd.to_datetime(made["at"], unit="ms")
            yield made

    def close(self) -> None:
        pass


def file_changes(observations: DataFrame, late: str = "1 day") -> DataFrame:
    """The stream ``path, status, mtime, size, at`` of a stream ``path, mtime, size, gone, at`` of observations; ``late`` is how far
    behind the newest one may be that still counts. Times count in milliseconds. At one time of a path the smaller
    ``mtime``, then ``size`` comes first, and being gone last. Rows without a path, a time of their own or (unless gone) an
    ``mtime`` and size are ignored."""
    ship(observations.sparkSession)
    seen = observations.withColumn("at", F.date_trunc("millisecond", F.col("at"))).withWatermark("at", late)
    zero = lambda c, kind: F.when(F.col("gone"), F.lit(0)).otherwise(F.col(c)).cast(kind).alias(c)
    rows = seen.select("path", F.unix_millis("at").alias("at_ms"), zero("mtime", "double"), zero("size", "long"), "gone", "at")
    rows = rows.where("path IS NOT NULL AND at IS NOT NULL AND gone IS NOT NULL AND mtime IS NOT NULL AND size IS NOT NULL")
    return rows.groupBy("path").transformWithStateInPandas(Follow(), CHANGES, "Append", "EventTime")


@contextmanager
def configured(spark: SparkSession, ours: dict[str, str]):
    """Settings for the queries that are started within."""
    before = {name: spark.conf.get(name, None) for name in ours}
    for name, value in ours.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shuffles(partitions: int | None) -> dict[str, str]:
    return {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}


def rocks(spark: SparkSession, partitions: int | None = None):
    """State in RocksDB, which keyed timers and lists need, for the queries of ``file_changes`` that are started within;
    ``partitions``: of the state of those that start anew."""
    return configured(spark, {PROVIDER: ROCKS} | shuffles(partitions))


def _milliseconds(spark: SparkSession, late: str) -> int:
    return spark.range(1).select(F.expr(f"unix_millis(TIMESTAMP '2001-01-10 00:00:00' + INTERVAL {late}) - unix_millis(TIMESTAMP '2001-01-10 00:00:00')")).first()[0]


def _steps(due: DataFrame) -> DataFrame:
    """``due`` (``path, at_ms, mtime, size, gone``; a path's last state without a time) with ``status``, by the rules of ``status``."""
    order = Window.partitionBy("path").orderBy("at_ms", "mtime", "size", "gone")
    before = lambda c: F.lag(c).over(order)
    rows = due.select("*", F.coalesce(before("gone"), F.lit(True)).alias("_gone"), before("mtime").alias("_mtime"), before("size").alias("_size"))
    other = (F.col("mtime") != F.col("_mtime")) | (F.col("size") != F.col("_size"))
    made = F.when(F.col("gone"), F.when(~F.col("_gone"), "removed")).when(F.col("_gone"), "added").when(other, "changed")
    return rows.withColumn("status", made).where("at_ms IS NOT NULL")


def follow(observations: DataFrame, target: str, checkpoint: str, late: str = "1 day", partitions: int | None = None) -> None:
    """Takes in what the stream holds now and appends the changes that are settled to the Parquet table ``target``. Called
    again, with the same checkpoint, it goes on; a batch that failed is repeated, and written once.

    The results are those of ``file_changes``; what waits and each path's last state are tables below ``checkpoint``, under
    each batch's number, so a batch is a few joins and windows over many paths at once. A batch's changes replace what a
    failed try of it has left; a second stream carries them to ``target``. ``partitions``: of the shuffles, the session's
    number unless given."""
    spark = observations.sparkSession
    delay = _milliseconds(spark, late)

    def one(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        place, old = f"{checkpoint}/held/{number}", f"{checkpoint}/held/{number - 1}"
        read = lambda kind, schema: own.read.schema(schema).parquet(f"{old}/{kind}") if number else own.createDataFrame([], schema)
        newest = read("newest", "newest long").agg(F.max("newest")).first()[0]
        rows = batch.withColumn("at_ms", F.unix_millis(F.date_trunc("millisecond", F.col("at"))))
        zero = lambda c, kind: F.when(F.col("gone"), F.lit(0)).otherwise(F.col(c)).cast(kind).alias(c)
        seen = rows.select("path", "at_ms", zero("mtime", "double"), zero("size", "long"), "gone")
        seen = seen.where("path IS NOT NULL AND at_ms IS NOT NULL AND gone IS NOT NULL AND mtime IS NOT NULL AND size IS NOT NULL")
        seen = seen if newest is None else seen.where(F.col("at_ms") > newest - delay)
        now = max((x for x in (newest, rows.agg(F.max("at_ms")).first()[0]) if x is not None), default=None)
        held = read("waiting", _HELD).unionByName(seen)
        settled = F.lit(False) if now is None else F.col("at_ms") <= now - delay
        due = held.where(settled).unionByName(read("last", _HELD))
        made = _steps(due).where("status IS NOT NULL").select("path", "status", "mtime", "size", F.timestamp_millis("at_ms").alias("at"))
        made.write.mode("overwrite").parquet(f"{checkpoint}/changes/{number}")
        held.where(~settled).write.mode("overwrite").parquet(f"{place}/waiting")
        state = F.max_by(F.struct("mtime", "size", "gone"), F.struct("at_ms", "mtime", "size", "gone")).alias("s")
        last = due.groupBy("path").agg(state).select("path", F.lit(None).cast("long").alias("at_ms"), "s.*")
        last.write.mode("overwrite").parquet(f"{place}/last")
        own.createDataFrame([(now,)], "newest long").coalesce(1).write.mode("overwrite").parquet(f"{place}/newest")

    with configured(spark, shuffles(partitions)):
        observations.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/taken").trigger(availableNow=True).start().awaitTermination()
    try:
        spark.read.schema(CHANGES).parquet(f"{checkpoint}/changes/*")
    except AnalysisException as e:  # no batch ever came
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    append_to_table(spark.readStream.schema(CHANGES).parquet(f"{checkpoint}/changes/*"), target, f"{checkpoint}/put")
