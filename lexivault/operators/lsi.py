"""A learned embedding: latent semantics of a corpus by randomized singular value decomposition.

The matrix has a row for each text of a bounded sample and a column for each of ``buckets`` buckets of terms; an entry is the
logarithm of a term's count times its bucket's inverse document frequency. It is never brought together: each task multiplies
its own sparse rows with a small dense matrix, ``A'(A X)``, and what the tasks have is added up by ranges of buckets, first by
groups of tasks. After a few such passes over random directions their span holds the leading right singular vectors
(Halko, Martinsson, Tropp 2011); one more gives their order. The driver holds matrices of buckets by dimensions only.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexError_
from ..functions.embedding import Backend, register
from ..functions.text import CHAR_CAP, query_tokens
from ..runtime import ship, stored

BUCKETS, SAMPLE, OVERSAMPLED, PASSES = 1 << 14, 100_000, 8, 3
#: Ranges of buckets in which sums are added, and groups of tasks that are added first.
RANGES, GROUPS = 32, 32


def buckets_of(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's terms and the logarithms of one more than their counts; terms of a bucket count together."""
    counts = Counter(zlib.crc32(t.encode()) % buckets for t in query_tokens(text[:CHAR_CAP]))
    at = np.array(sorted(counts), dtype=np.int64)
    return at, np.log1p(np.array([counts[b] for b in at.tolist()], dtype=np.float64))


def _weighted(at: list[np.ndarray], w: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, buckets and weights of texts' buckets and logarithms, rows at unit length."""
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    col = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
    val = np.concatenate(w) * idf[col] if at else np.zeros(0)
    norm = np.sqrt(np.bincount(row, val * val, minlength=len(at)))
    return row, col, val / np.where(norm > 0, norm, 1)[row]


def _summed(group: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of ``rows`` by ``group``, of ``n``."""
    out = np.zeros((n, rows.shape[1]))
    if len(group):
        order = np.argsort(group, kind="stable")
        start = np.flatnonzero(np.diff(group[order], prepend=-1))
        out[group[order[start]]] = np.add.reduceat(rows[order], start, axis=0)
    return out


def _times(row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
    return _summed(row, val[:, None] * x[col], n)


@dataclass
class SvdModel:
    """``vectors``: the leading right singular vectors, buckets by dimensions; their ``values``; the buckets' ``idf``."""

    vectors: np.ndarray
    values: np.ndarray
    idf: np.ndarray

    @classmethod
    def fit(cls, texts: DataFrame, text_col: str = "content", dim: int = 64, buckets: int = BUCKETS, sample: int = SAMPLE, passes: int = PASSES, seed: int = 1) -> SvdModel:
        """From about ``sample`` texts at most, an expected number by a hash of the text. A corpus of fewer texts or terms than
        dimensions gives zeros for the rest; an empty one gives zeros only."""
        ship(texts.sparkSession)
        rows = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
        n = rows.count()
        kept = rows if n <= sample else rows.where(F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [buckets_of(t, buckets) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([a.tolist() for a, _ in made], pa.list_(pa.int32())), pa.array([w.tolist() for _, w in made], pa.list_(pa.float64()))], names=["at", "w"])

        given = stored(kept.mapInArrow(read, "at array<int>, w array<double>"), "lsi-sample")  # texts are read once

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(buckets, dtype=np.int64), 0
            for batch in batches:
                count += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
                total += batch.num_rows
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(count[some], total))], names=["b", "n"])

        found = given.mapInArrow(held, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()  # a row per bucket
        df, total = np.zeros(buckets), 0
        for r in found:
            if r.b < 0:
                total = r.n
            else:
                df[r.b] = r.n
        idf = np.where(df > 0, np.log((total + 1) / (df + 0.5)), 0.0)
        width = min(dim + OVERSAMPLED, buckets)
        x = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, width)))[0]
        for _ in range(passes):
            x = np.linalg.qr(cls._squared(given, idf, x))[0]
        core = x.T @ cls._squared(given, idf, x)
        values, turn = np.linalg.eigh((core + core.T) / 2)
        order = np.argsort(values)[::-1][:dim]
        values = np.sqrt(np.maximum(values[order], 0))
        vectors = (x @ turn[:, order]) * (values > 1e-9)
        vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)  # a sign for each
        pad = dim - len(order)
        return cls(np.pad(vectors, ((0, 0), (0, pad))).astype(np.float32), np.pad(values, (0, pad)), idf)

    @staticmethod
    def _squared(given: DataFrame, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
        """``A'(A x)`` of the matrix of ``given``."""
        step = -(-len(idf) // RANGES)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros_like(x)
            for batch in batches:
                at, w = ([v.values.to_numpy() for v in batch.column(c)] for c in (0, 1))
                row, col, val = _weighted(at, w, idf)
                out += _summed(col, val[:, None] * _times(row, col, val, batch.num_rows, x)[row], len(idf))
            parts = [out[k : k + step].tobytes() for k in range(0, len(idf), step)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["at", "z"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(z.as_buffer()) for z in table.column("z"))
            return pa.table({"at": table.column("at")[:1], "z": pa.array([total.tobytes()], pa.binary())})

        made = given.mapInArrow(multiply, "at int, z binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        once = made.groupBy("at", "g").applyInArrow(add, "at int, z binary")
        rows = once.groupBy("at").applyInArrow(add, "at int, z binary").orderBy("at").collect()
        return np.concatenate([np.frombuffer(r.z) for r in rows]).reshape(x.shape) if rows else np.zeros_like(x)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, float(w), v.tolist()) for k, (w, v) in enumerate(zip(self.idf, self.vectors))] + [(-1, 0.0, self.values.tolist())]
        spark.createDataFrame(rows, "bucket int, idf double, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SvdModel:
        rows = spark.read.parquet(path).orderBy("bucket").collect()
        return cls(np.array([r.v for r in rows[1:]], dtype=np.float32), np.array(rows[0].v), np.array([r.idf for r in rows[1:]]))


class SvdBackend(Backend):
    """A model's projections of texts, at unit length; zeros for texts without a known term."""

    def __init__(self, model: SvdModel, device: str = "cpu", name: str | None = None):
        self.model, self.dim, self.device = model, model.vectors.shape[1], device
        self.name = name or f"svd:{self.dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        made = [buckets_of(t or "", len(self.model.idf)) for t in texts]
        out = _times(*_weighted([a for a, _ in made], [w for _, w in made], self.model.idf), len(texts), self.model.vectors.astype(np.float64))
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def _from_config(model: str, device: str) -> SvdBackend:
    """``svd:<path>``: a model that was saved there."""
    spark, path = SparkSession.getActiveSession(), model.partition(":")[2]
    if spark is None or not path:
        raise IndexError_("config.model_backend_mismatch", "the backend svd needs a session and a model svd:<path>", key="embed_model", value=model)
    return SvdBackend(SvdModel.load(spark, path), device, model)


register("svd", _from_config)
