"""The relational core of keeping an index current: what changed, what stays, and ids that are never used again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored


def classify(known: DataFrame, walked: DataFrame) -> DataFrame:
    """``path, status``: added, changed, unchanged or removed, by exact equality of ``mtime`` and ``size``."""
    a = known.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.lit(True).alias("_known"))
    b = walked.select("path", "mtime", "size", F.lit(True).alias("_walked"))
    same = F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size"))
    status = F.when(F.col("_known").isNull(), "added").when(F.col("_walked").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def counts(classified: DataFrame) -> DataFrame:
    """One row: ``added, changed, unchanged, removed``."""
    return classified.agg(*[F.count(F.when(F.col("status") == s, True)).alias(s) for s in ("added", "changed", "unchanged", "removed")])


def removed(known: DataFrame, walked: DataFrame) -> DataFrame:
    return known.select("path").join(walked.select("path"), "path", "left_anti")


def still_known(known: DataFrame, walked: DataFrame) -> DataFrame:
    return known.select("path").join(walked.select("path"), "path")


def victims(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks of the files ``paths``."""
    return chunks.join(paths.select("path"), "path", "left_semi")


def survivors(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select("path"), "path", "left_anti")


def upsert_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """``files`` with the rows of ``new`` in place of those of equal path."""
    return files.join(new.select("path"), "path", "left_anti").unionByName(new)


def first_chunk(chunks: DataFrame) -> DataFrame:
    """``path, chunk_id``: the smallest chunk id of each file, which its symbols and edges hang on."""
    return chunks.groupBy("path").agg(F.min("id").alias("chunk_id"))


def assign_ids(rows: DataFrame, order: list[str], next_id: int = 1) -> DataFrame:
    """``rows`` with ``id`` from ``next_id`` on in the order of ``order``.

    Rows are sorted by range into partitions and stored with their place in them; a row's id is its place after the counts
    of the partitions before: no task sorts the whole, and nothing is drawn anew if an executor is lost.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(spread, "ids")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part")  # one row per partition
    return numbered.withColumn("id", (F.col("_before") + at + F.lit(next_id)).cast("long")).drop("_part", "_at", "_before")


def apply(chunks: DataFrame, replaced: DataFrame, new: DataFrame, next_id: int) -> DataFrame:
    """Chunks after a sync: those of files not in ``replaced`` keep their ids, ``new`` ones get ids from ``next_id`` on."""
    fresh = assign_ids(new, ["path", "start_line", "end_line"], next_id)
    return survivors(chunks, replaced).unionByName(fresh.select(*chunks.columns))
