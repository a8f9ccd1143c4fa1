"""Nearest neighbours of a query vector, exactly, by L2 or cosine distance in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import top


def l2(vector: Column, query: Sequence[float]) -> Column:
    """Euclidean distance to a literal; no join is needed."""
    other = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(vector.cast("array<double>"), other, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    other = F.array(*[F.lit(float(x)) for x in query])
    v = vector.cast("array<double>")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    norm = float(np.sqrt(sum(float(x) ** 2 for x in query)))
    return 1 - total(F.zip_with(v, other, lambda a, b: a * b)) / (F.sqrt(total(F.transform(v, lambda a: a * a))) * norm)


def matrix_distance(vector: Column, query: Sequence[float], metric: str = "l2") -> Column:
    """The same distances from whole Arrow batches: for long vectors, where interpreted lambdas are slow."""
    q = np.array(query, dtype=np.float64)

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, len(q)))
        if metric == "l2":
            return pd.Series(np.sqrt(((x - q) ** 2).sum(axis=1)))
        return pd.Series(1 - x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)))

    return distance(vector)


def nearest(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
    """``id, distance, rank`` of the ``k`` nearest rows of ``vectors`` (``chunk_id, embedding``)."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"no such metric: {metric}")
    distance = (l2 if metric == "l2" else cosine_distance)(F.col("embedding"), query)
    return top(vectors.select(F.col("chunk_id").alias("id"), distance.alias("distance")), k, [F.asc("distance"), F.asc("id")])
