"""Nearest rows of many query vectors at once, exactly: products of blocks of queries with blocks of vectors.

Queries are dealt to blocks of about ``QUERIES`` and packed into matrices, vectors are packed where they are read. Every pack of
vectors meets every block of queries by a join on the block's number: queries that fit Spark's limit are broadcast and no
vector is moved; more are dealt with the packs to tasks. A first pass over a part of the vectors gives for each
query a distance that its ``k``-th best can't exceed; in the second, over all, a task passes on what isn't beyond that, and of
each pack and query ``k`` rows at most. Distances that decide are computed from differences, not from the product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship, stored

QUERIES = 1024
#: Bytes of a matrix.
BYTES = 2 << 20
#: One in so many vectors is in the first pass.
PART = 32


def usable(column: str) -> Column:
    """Whether a vector holds finite numbers only, and some."""
    x = F.col(column)
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _packed(rows: DataFrame) -> DataFrame:
    """``block, ids, x, dim``: matrices of ``block, id, x`` rows of equal block and length, as they come and of ``BYTES`` at most;
    rows of a block must stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out(dim: int) -> pa.RecordBatch:
            ids, x = zip(*held.pop(dim))
            data = [pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(x).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *data, pa.array([dim], pa.int32())], names=["block", "ids", "x", "dim"])

        for batch in batches:
            for block, ident, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = v.values.to_numpy(zero_copy_only=False)
                if block != now:
                    yield from [out(dim) for dim in list(held)]
                    now = block
                held.setdefault(len(x), []).append((ident, x))
                if len(held[len(x)]) * len(x) * 8 >= BYTES:
                    yield out(len(x))
        yield from [out(dim) for dim in list(held)]

    return rows.select("block", "id", "x").mapInArrow(run, "block int, ids binary, x binary, dim int")


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and distances of the rows of ``x`` not beyond its bound, of more than ``k`` the first."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms = (x * x).sum(axis=1)
        near = norms + (q * q).sum(axis=1)[:, None] - 2 * (q @ x.T)
    # what rounding may have done to the product's squares; where they overflow, all rows are taken
    slack = 1e-9 * (norms.max() + (q * q).sum(axis=1)) + 1e-300
    for j in range(len(q)):
        limit = min(float(np.partition(near[j], k - 1)[k - 1]) if len(ids) > k else np.inf, bound[j] ** 2 * (1 + 1e-9)) + 2 * slack[j]
        some = np.flatnonzero(near[j] <= limit) if np.isfinite(limit) and np.isfinite(near[j]).all() else np.arange(len(ids))
        distance = np.sqrt(((x[some] - q[j]) ** 2).sum(axis=1))
        some, distance = some[distance <= bound[j]], distance[distance <= bound[j]]
        order = np.lexsort((ids[some], distance))[:k]
        yield j, ids[some[order]], distance[order]


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, part: int = PART) -> DataFrame:
    """``query, id, distance, rank`` of the ``k`` nearest rows of ``vectors`` (``chunk_id, embedding``) to each row of ``queries``
    (``query, embedding``), by L2 distance in double precision; ties go to the smaller id.

    Null ids and vectors that are null, empty or hold null or non-finite components are in no result and ask nothing; vectors
    are compared with those of their own length. Repeated rows stay rows of their own; a query's id must not repeat.
    """
    ship(vectors.sparkSession)
    double = F.col("embedding").cast("array<double>").alias("x")
    rows = vectors.select(F.col("chunk_id").cast("long").alias("id"), double).where(F.col("id").isNotNull() & usable("x"))
    asked = queries.select(F.col("query").cast("long").alias("id"), double).where(F.col("id").isNotNull() & usable("x"))
    asked = stored(asked, "batch-asked")
    number = max(1, -(-asked.count() // QUERIES))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(number)).cast("int")).repartition("block").sortWithinPartitions("block", "id")
    blocks = stored(_packed(dealt), "batch-queries")

    def pass_over(some: DataFrame, bounds: DataFrame | None) -> DataFrame:
        """The first ``k`` of each query and pack."""
        bounded = bounds is not None
        packs = _packed(some.withColumn("block", F.lit(0))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
        held = blocks.withColumnsRenamed({"ids": "q_ids", "x": "q"})
        if bounded:
            held = held.join(bounds, "block", "left")
        pairs = packs.join(held, ["block", "dim"]).select("ids", "x", "dim", "q_ids", "q", *["known"] * bounded)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    dim = batch.column("dim")[row].as_py()
                    x, q = (np.frombuffer(batch.column(c)[row].as_buffer(), dtype=np.float64).reshape(-1, dim) for c in ("x", "q"))
                    ids, own = (np.frombuffer(batch.column(c)[row].as_buffer(), dtype=np.int64) for c in ("ids", "q_ids"))
                    known = dict(batch.column("known")[row].as_py() or ()) if bounded else {}
                    bound = np.array([known.get(int(j), np.inf) for j in own])
                    found = [(np.full(len(i), own[j]), i, d) for j, i, d in _nearest(x, ids, q, bound, k)]
                    if found:
                        a, b, c = (np.concatenate(v) for v in zip(*found))
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["query", "id", "distance"])

        return pairs.mapInArrow(run, "query long, id long, distance double")

    def first(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

    sample = pass_over(rows.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0), None)
    limit = first(sample).where(F.col("rank") == k).select("query", F.col("distance").alias("limit"))
    ids = blocks.select("block", "ids").mapInArrow(_listed, "block long, query long")
    bounds = ids.join(limit, "query").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query", "limit"))).alias("known"))
    return first(pass_over(rows, stored(bounds, "batch-limits")))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(ids.as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own)], names=["block", "query"])
