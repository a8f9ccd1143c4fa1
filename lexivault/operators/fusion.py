"""Reciprocal rank fusion of two ranked pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import RRF_K


def contribution(rank: Column) -> Column:
    return 1 / (F.lit(RRF_K) + rank)


def single_pool(pool: DataFrame) -> DataFrame:
    return pool.select("id", contribution(F.col("rank")).alias("score"), F.col("rank").alias("order"))


def fuse(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """``id, score, bm25_rank, dense_rank`` of the pools' union."""
    a, b = lexical.select("id", F.col("rank").alias("bm25_rank")), dense.select("id", F.col("rank").alias("dense_rank"))
    both = a.join(b, "id", "full_outer")
    part = lambda c: F.coalesce(contribution(F.col(c)), F.lit(0.0))
    return both.select("id", (part("bm25_rank") + part("dense_rank")).alias("score"), "bm25_rank", "dense_rank")


#: Best score first; then the better dense rank, those without one last; then the id.
ORDER = (F.desc, "score"), (F.asc_nulls_last, "dense_rank"), (F.asc, "id")


def fused_order() -> list[Column]:
    return [f(c) for f, c in ORDER]
