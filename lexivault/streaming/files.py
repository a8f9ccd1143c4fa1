"""Structured Streaming: keeping a files table current from a stream of states, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``window_start, event_type, n, total`` of a batch or a stream of events (``ts, event_type, value``)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def stream_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drains a stream into the in-memory table ``name``: for queries and tests, not for sinks."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def append_to_table(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Takes in what the stream holds and appends what is final to the Parquet table ``target``, each batch once: of windows
    those that the watermark has passed. Called again, it goes on; no result passes through the driver."""
    stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sync_stream(stream: DataFrame, target: str, checkpoint: str) -> int | None:
    """Upserts each batch of file states (``path, mtime, size``) into the Parquet table at ``target``, which is written
    under a new number each time; returns the last one, None if no batch came. A batch that is delivered again, after a
    failure, gives the same table."""
    spark = stream.sparkSession
    last: list[int] = []

    def one(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct("mtime", "size"), "mtime").alias("s")).select("path", "s.*")
        before = spark.read.parquet(f"{target}/{number - 1}") if number else spark.createDataFrame([], latest.schema)
        changes.upsert_files(before, latest).write.mode("overwrite").parquet(f"{target}/{number}")
        last[:] = [number]

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return last[0] if last else None


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
