"""A dense index: an inverted file of cells with residual codes, searched for many queries at once.

1. Cells are the centroids of k-means over a bounded sample of the vectors; each round is one pass of tasks over the stored
   sample. Every vector is then put into its nearest cell, and the cell's radius is known.
2. A vector is kept as its difference to the centroid in signed bytes of a scale of its own, with the exact length of what
   rounding lost. So a code gives the distance between a lower and an upper bound. Codes of a cell stand in blocks.
3. A query opens the cells nearest to it, as many as let some of the vectors find nearly all of their true neighbours. In each block what can't be among the ``k`` best by the bounds is left out, then
   among all blocks; the rest is joined to the vectors and ranked by exact distances.
4. If asked for exactness, cells follow that weren't opened but, by the triangle inequality, may hold a vector within the
   ``k``-th distance found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship, stored
from .batch import nearest_batch, usable
from .skew import salted_join

#: Cells at most, vectors of the sample to a cell, rounds of k-means, and rows of a block of codes or of queries.
MOST_CELLS, SAMPLED, ROUNDS, BLOCK = 4096, 128, 8, 2048
#: Queries by which the number of cells to open is set, their neighbours, and the part of these that is to be found.
TRIED, TRIED_K, RECALL = 64, 10, 0.95


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0)


def fit_cells(rows: DataFrame, cells: int | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of ``id, x`` (a stored table): as many as the root of the rows unless given, ``MOST_CELLS`` at most, from
    ``SAMPLED`` rows for each (an expected number, by a hash of the ids). The driver holds the centroids."""
    n = rows.count()
    cells = min(cells or max(1, math.isqrt(n)), MOST_CELLS, max(n, 1))
    part = min(1.0, cells * SAMPLED / max(n, 1))
    place = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30))
    sample = stored(rows.where(place < int(part * (1 << 30)) + 1).select("x", place.alias("place")), "ivf-sample")
    seeds = [r.x for r in sample.groupBy("x").agg(F.min("place").alias("place")).orderBy("place", "x").limit(cells).collect()]
    centroids = np.array(seeds or [r.x for r in rows.select("x").limit(1).collect()], dtype=np.float64).astype(np.float32).astype(np.float64)
    for _ in range(rounds if len(centroids) > 1 else 0):
        now = centroids

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(now), np.zeros(len(now), dtype=np.int64)
            for batch in batches:
                x = _matrix(batch.column(0))
                cell = _squares(x, now).argmin(axis=1)
                np.add.at(sums, cell, x)
                counts += np.bincount(cell, minlength=len(now))
            for c in np.flatnonzero(counts):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([counts[c]], pa.int64()), pa.array([sums[c].tolist()], pa.list_(pa.float64()))], names=["cell", "n", "s"])

        def add(table: pa.Table) -> pa.Table:
            return pa.table({"cell": table.column("cell")[:1], "c": pa.array([(_matrix(table.column("s").combine_chunks()).sum(axis=0) / sum(table.column("n").to_pylist())).tolist()], pa.list_(pa.float64()))})

        found = sample.select("x").mapInArrow(gather, "cell int, n long, s array<double>").groupBy("cell").applyInArrow(add, "cell int, c array<double>").collect()
        centroids = now.copy()
        for r in found:  # a cell without rows stays
            centroids[r.cell] = np.array(r.c, dtype=np.float32)
    return centroids


@dataclass
class Codes:
    """Residuals as signed bytes times a row's scale; ``lost``: the length of what rounding left out."""

    code: np.ndarray
    scale: np.ndarray
    lost: np.ndarray

    @classmethod
    def of(cls, residual: np.ndarray) -> Codes:
        scale = np.abs(residual).max(axis=1) / 127
        code = np.rint(residual / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
        lost = np.sqrt(((residual - code * scale[:, None]) ** 2).sum(axis=1))
        return cls(code, scale, lost)

    def vectors(self) -> np.ndarray:
        return self.code * self.scale[:, None]


def bounded(codes: Codes, query: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query (less the centroid) the rows that may be among the ``k`` nearest, with bounds of their distances."""
    x = codes.vectors()
    near = np.sqrt(_squares(query, x))
    slack = 1e-7 * (np.sqrt((x * x).sum(axis=1).max(initial=0)) + np.sqrt((query * query).sum(axis=1)))  # of the product
    for j in range(len(query)):
        low, high = near[j] - codes.lost - slack[j], near[j] + codes.lost + slack[j]
        some = np.flatnonzero(low <= np.partition(high, k - 1)[k - 1]) if len(high) > k else np.arange(len(high))
        yield j, some, low[some], high[some]


def _enough(rows: DataFrame, coded: DataFrame, centroids: np.ndarray, recall: float) -> int:
    """Cells to open so that ``TRIED`` of the vectors find the part ``recall`` of their true neighbours, themselves left out.
    Structure decides: of well parted clusters few cells do, of vectors without any most are needed."""
    if len(centroids) < 2:
        return 1
    tried = rows.groupBy("id").agg(F.first("x").alias("x")).orderBy(F.xxhash64("id", F.lit(21)), "id").limit(TRIED)
    tried = stored(tried.select(F.col("id").alias("query"), F.col("x").alias("embedding")), "ivf-tried")
    true = nearest_batch(rows.select(F.col("id").alias("chunk_id"), F.col("x").alias("embedding")), tried, TRIED_K + 1).where("id <> query")
    found = true.join(coded, "id").groupBy("query", "id").agg(F.min("cell").alias("cell")).join(tried, "query").select("embedding", "cell").collect()
    if not found:
        return 1
    squares = _squares(np.array([r.embedding for r in found]), centroids)
    place = np.sort([int((row <= row[r.cell]).sum()) for row, r in zip(squares, found)])
    return int(place[min(len(place) - 1, math.ceil(recall * len(place)) - 1)])


@dataclass
class IvfIndex:
    """``vectors``: ``id, x``; ``blocks``: ``cell, n, ids, codes, scales, lost``, sorted by cell; ``centroids`` and the ``radii`` of
    their cells."""

    vectors: DataFrame
    blocks: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    #: Cells that a query opens unless told.
    probes: int = 1

    @classmethod
    def build(cls, vectors: DataFrame, cells: int | None = None, recall: float = RECALL) -> IvfIndex:
        """An index of every usable row of ``vectors`` (``chunk_id, embedding``): those with an id whose vector has the length of
        the smallest such id's and holds finite numbers only. Equal ids are rows of their own."""
        ship(vectors.sparkSession)
        rows = vectors.select(F.col("chunk_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x")).where(F.col("id").isNotNull() & usable("x"))
        first = rows.orderBy("id", "x").select(F.size("x").alias("n")).first()
        if first is not None:
            rows = rows.where(F.size("x") == first.n)
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "ivf-vectors")
        centroids = fit_cells(rows, cells) if first is not None else np.zeros((0, 0))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(2))
                cell = _squares(x, centroids).argmin(axis=1)
                made = Codes.of(x - centroids[cell])
                distance = np.sqrt(((x - centroids[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in made.code], pa.binary()), pa.array(made.scale), pa.array(made.lost), pa.array(distance)], names=["id", "row", "cell", "code", "scale", "lost", "distance"])

        coded = stored(rows.select("id", "row", "x").mapInArrow(assign, "id long, row long, cell int, code binary, scale double, lost double, distance double"), "ivf-codes")
        sizes = coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
        radii = np.full(len(centroids), -np.inf)
        for r in sizes.collect():  # a row per cell
            radii[r.cell] = r.radius
        # a cell may hold any part of the rows: it is cut into parts before they are brought together
        parts = stored(sizes.select("cell", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("parts")), "ivf-parts")
        dealt = coded.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []

            def out() -> pa.RecordBatch:
                row, code, scale, lost = zip(*held)
                data = [np.array(row, dtype=np.int64).tobytes(), b"".join(code), np.array(scale).tobytes(), np.array(lost).tobytes()]
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([len(row)], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], names=["cell", "n", "rows", "codes", "scales", "lost"])

            for batch in batches:
                for cell, part, *rest in zip(*(batch.column(c).to_pylist() for c in ("cell", "part", "row", "code", "scale", "lost"))):
                    if held and ((cell, part) != key or len(held) >= 2 * BLOCK):
                        yield out()
                        held = []
                    key = cell, part
                    held.append(rest)
            if held:
                yield out()

        spread = dealt.select("cell", "part", "row", "code", "scale", "lost").repartitionByRange("cell", "part").sortWithinPartitions("cell", "part")
        blocks = stored(spread.mapInArrow(pack, "cell int, n int, rows binary, codes binary, scales binary, lost binary"), "ivf-blocks")
        return cls(rows, blocks, centroids, radii, _enough(rows, coded.select("id", "cell"), centroids, recall))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, opened: list | None = None) -> DataFrame:
        """``query, id, distance, rank`` of the ``k`` nearest rows by L2 distance among those of the ``probes`` nearest cells, or,
        if ``exact``, among all. ``queries``: ``query, embedding``; ids that don't repeat. Ties go to the smaller id. Queries that
        are null, of another length or not finite find nothing. ``opened`` gets the tables ``query, cell``."""
        spark = self.blocks.sparkSession
        if not len(self.centroids):
            return spark.createDataFrame([], "query long, id long, distance double, rank long")
        probes, centroids, radii = min(probes or self.probes, len(self.centroids)), self.centroids, self.radii
        asked = queries.select(F.col("query").cast("long").alias("query"), F.col("embedding").cast("array<double>").alias("q"))
        asked = stored(asked.where(F.col("query").isNotNull() & usable("q") & (F.size("q") == centroids.shape[1])), "ivf-queries")

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = np.argsort(_squares(_matrix(batch.column(1)), centroids), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), near.shape[1])), pa.array(near.ravel(), pa.int32())], names=["query", "cell"])

        first = stored(asked.mapInArrow(nearest, "query long, cell int"), "ivf-probes")
        found = self._ranked(asked, self._candidates(asked, first, k), k)
        if opened is not None:
            opened.append(first)
        if not exact:
            return found
        found = stored(found, "ivf-found")
        limit = found.where(F.col("rank") == k).select("query", F.col("distance").alias("limit"))

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                distance = np.sqrt(_squares(_matrix(batch.column(1)), centroids))
                limits = np.array([np.inf if v is None else v for v in batch.column(2).to_pylist()])
                slack = 1e-7 * (1 + distance)
                may = distance - radii - slack <= limits[:, None]
                q, cell = np.nonzero(may)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), pa.array(cell, pa.int32())], names=["query", "cell"])

        more = asked.join(limit, "query", "left").mapInArrow(others, "query long, cell int").join(first, ["query", "cell"], "left_anti")
        more = stored(more, "ivf-more")
        if opened is not None:
            opened.append(more)
        rest = self._ranked(asked, self._candidates(asked, more, k), k)
        return _first(found.drop("rank").unionByName(rest.drop("rank")), k)

    def _candidates(self, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """``query, row`` of what may be among the ``k`` nearest of the cells ``pairs`` (``query, cell``)."""
        centroids = self.centroids

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []

            def out() -> pa.RecordBatch:
                ids, x = zip(*held)
                return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([np.array(x).tobytes()], pa.binary())], names=["cell", "queries", "q"])

            for batch in batches:
                for cell, ident, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    if held and (cell != key or len(held) >= BLOCK):
                        yield out()
                        held = []
                    key = cell
                    held.append((ident, x.values.to_numpy()))
            if held:
                yield out()

        packs = pairs.join(asked, "query").select("cell", "query", "q").repartitionByRange("cell", "query").sortWithinPartitions("cell", "query").mapInArrow(pack, "cell int, queries binary, q binary")
        met = salted_join(self.blocks, stored(packs, "ivf-packs"), "cell", most=64, name="ivf")

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    raw = lambda c, kind: np.frombuffer(batch.column(c)[r].as_buffer(), dtype=kind)  # noqa: B023, E731
                    cell, rows, own = batch.column("cell")[r].as_py(), raw("rows", np.int64), raw("queries", np.int64)
                    codes = Codes(raw("codes", np.int8).reshape(len(rows), -1), raw("scales", np.float64), raw("lost", np.float64))
                    query = raw("q", np.float64).reshape(len(own), -1) - centroids[cell]
                    found = [(np.full(len(s), own[j]), rows[s], low, high) for j, s, low, high in bounded(codes, query, k)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*found)], names=["query", "row", "low", "high"])

        may = stored(met.select("cell", "rows", "codes", "scales", "lost", "queries", "q").mapInArrow(bound, "query long, row long, low double, high double"), "ivf-bounds")
        place = F.row_number().over(Window.partitionBy("query").orderBy("high", "row"))
        limit = may.withColumn("at", place).where(F.col("at") <= k).where(F.col("at") == k).select("query", F.col("high").alias("limit"))
        return may.join(limit, "query", "left").where(F.col("limit").isNull() | (F.col("low") <= F.col("limit"))).select("query", "row")

    def _ranked(self, asked: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
        pairs = candidates.join(self.vectors, "row").join(asked, "query")
        distance = F.sqrt(F.aggregate(F.zip_with("x", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        return _first(pairs.select("query", "id", distance.alias("distance")), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
