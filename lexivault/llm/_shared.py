"""What the operators of this subpackage have in common: stored tables and connected components."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..runtime import stored

__all__ = ["beside", "connected_components", "lean", "named", "release", "salted_join", "stored"]


def named(name: str) -> Column:
    """The column of this very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def beside(df: DataFrame, keep: tuple[str, ...], value: Column) -> tuple[DataFrame, list]:
    """The columns ``keep`` of ``df`` and ``value`` under names that can't clash, and the kept columns' fields."""
    own = [named(name) for name in keep]
    return df.select(*[c.alias(f"c{k}") for k, c in enumerate(own)], value.alias("value")), df.select(*own).schema.fields


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps whose results are stored. Spark drops them when the driver's garbage is
    collected, which otherwise may be much later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean() -> None:
    """Gives free memory of this process back to the system. Python workers are used again, stage after stage, and what the
    allocators keep of each adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc's only
        trim(0)


def connected_components(vertices: DataFrame, edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable id of every vertex.

    ``vertices``: one long column ``id``, distinct; ``edges``: long columns ``a`` and ``b`` in any direction, repeats
    and loops allowed. Returns ``id, component_id``. Alternates large-star and small-star rounds (Kiveris et al. 2014)
    until no edge changes, in O(log^2 n) rounds; each round's edges are written to the shared folder, so lineage stays
    short. A hub is never collected: a round is one ``min`` per vertex, which Spark combines before the shuffle, and a
    join on the vertex, whose hot partitions adaptive execution splits.
    """
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large-star: neighbours above a vertex are linked to the smallest of its neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: a vertex and its neighbours below are linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        nxt = stored(small, name)
        # settled when every vertex has one edge and no root is itself below another
        state = nxt.agg(F.count("*").alias("n"), F.count_distinct("a").alias("d")).first()
        if state.n == state.d and nxt.select(F.col("b").alias("a")).join(nxt, "a", "left_semi").isEmpty():
            break
        cur = nxt
    return vertices.join(nxt.select(F.col("a").alias("id"), F.col("b").alias("component_id")), "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))
