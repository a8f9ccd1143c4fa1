"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored


def salted_join(rows: DataFrame, other: DataFrame, key: str, most: int = 512, name: str = "salted") -> DataFrame:
    """Every row of ``rows`` with each row of ``other`` that has the same ``key`` (rows without one go).

    A key that may hold a third of all rows is dealt: beyond ``most`` rows of a key, its rows go to parts of about ``most``
    and its rows of ``other`` to each of them. The list of such keys has at most one in ``most`` of the rows; Spark
    chooses by its size how it is joined. ``rows`` should be a stored table or a scan, so that a repeated task deals
    its rows as before. Null keys find nothing.
    """
    heavy = stored(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / F.lit(most)).cast("int").alias("_parts")), f"{name}-heavy")
    place = F.xxhash64(F.monotonically_increasing_id(), F.lit(13))
    dealt = rows.where(F.col(key).isNotNull()).withColumn("_place", place).join(heavy, key, "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod("_place", "_parts"), F.lit(0)).cast("int")).drop("_parts", "_place")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    copied = other.join(heavy, key, "left").withColumn("_part", parts).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")
