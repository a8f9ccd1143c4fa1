"""Vector codes: product quantisation in whole numbers, entries found by vantage-point trees.

Components become whole numbers, vectors are cut into equal parts, and each part position has a codebook of at most 256
entries. Each round is one pass over the stored vectors: every part finds its nearest entry, and sums and counts by entry
and place are added up by Spark, so the driver gets a row per entry and component whatever the number of vectors.
Everything that decides is a whole number, so order, partitioning and machine change nothing.

A part's entries stand in a vantage-point tree: a node is an entry, its other entries lie in a near and a far half, and each
half is known by the least and greatest distance to the node, rounded down and up. A query visits a half unless the
triangle inequality rules it out: the bound, rounded in the half's favour, must exceed the best distance found so
far. A half that could hold an equally near entry is visited too, since the lower index wins; candidates are compared by
their exact squared distances. Whole batches go down the tree together, each query into its own nearer half first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from ._shared import named, salted_join, stored

PARTS, ENTRIES, SCALE, ROUNDS = 8, 16, 4096, 6
#: Sums of whole numbers below this are exact in 64 bits; beyond it Python's integers are used.
SAFE = 1 << 62


def wide(x: np.ndarray, terms: int, others: np.ndarray | None = None) -> np.ndarray:
    """``x`` as it is if ``terms`` squares of its differences to ``others`` (or, without, ``terms`` of its values) add up
    exactly in 64 bits, else as Python's integers."""
    if x.dtype == object or not x.size:
        return x
    span = max(abs(int(x.min())), abs(int(x.max())))
    if others is not None:
        span = (span + max((abs(int(v)) for v in (others.min(), others.max())), default=0)) ** 2
    return x if span * terms < SAFE else x.astype(object)


def root(squares: np.ndarray) -> np.ndarray:
    """Square roots rounded down, exactly."""
    if squares.dtype == object:
        return np.array([math.isqrt(int(v)) for v in squares], dtype=object)
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    r = root(squares)
    return r + (r * r < squares)


@dataclass
class Half:
    """Entries whose distances to a node lie between ``least``, rounded down, and ``most``, rounded up."""

    node: Node
    least: int
    most: int


@dataclass
class Node:
    entry: int
    middle: int = 0  #: greatest squared distance of the near half
    near: Half | None = None
    far: Half | None = None


class Tree:
    """A vantage-point tree over the rows of ``entries``, whole numbers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.visited = 0  #: distances computed so far
        self.top = self._node(list(range(len(entries)))) if len(entries) else None

    def _squares(self, x: np.ndarray, entry: int) -> np.ndarray:
        d = x - self.entries[entry]
        return (d * d).sum(axis=1)

    def _node(self, rows: list[int]) -> Node:
        node, rest = Node(rows[0]), rows[1:]
        if rest:
            some = self.entries[rest]
            squares = [int(v) for v in self._squares(wide(some, some.shape[1], self.entries), rows[0])]
            order = sorted(range(len(rest)), key=lambda k: (squares[k], rest[k]))
            cut = (len(order) + 1) // 2
            node.middle = squares[order[cut - 1]]
            for name, part in (("near", order[:cut]), ("far", order[cut:])):
                if part:
                    most = squares[part[-1]]
                    up = math.isqrt(most) + (math.isqrt(most) ** 2 < most)
                    setattr(node, name, Half(self._node([rest[k] for k in part]), math.isqrt(squares[part[0]]), up))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` the index of the nearest entry (of equally near ones the lowest) and its squared distance."""
        x = wide(x, x.shape[1] or 1, self.entries)
        n = len(x)
        index = np.zeros(n, dtype=np.int64)
        best = np.full(n, -1, dtype=x.dtype)  # -1: nothing found yet

        def visit(node: Node, rows: np.ndarray) -> None:
            squares = self._squares(x[rows], node.entry)
            self.visited += len(rows)
            so_far = best[rows]
            better = (so_far < 0) | (squares < so_far) | ((squares == so_far) & (node.entry < index[rows]))
            best[rows[better]], index[rows[better]] = squares[better], node.entry
            if node.near is None:
                return
            down, up, inside = root(squares), root_up(squares), np.asarray(squares <= node.middle, dtype=bool)
            for own, halves in ((inside, (node.near, node.far)), (~inside, (node.far, node.near))):
                for half in halves:
                    if half is not None and own.any():
                        some = rows[own]
                        reach = root_up(best[some])
                        may = np.asarray((down[own] - half.most <= reach) & (half.least - up[own] <= reach), dtype=bool)
                        if may.any():
                            visit(half.node, some[may])

        if self.top is not None and n:
            visit(self.top, np.arange(n))
        return index, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _found(x: np.ndarray, trees: list[Tree], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for p, tree in enumerate(trees):
        part = x[:, p * length : (p + 1) * length]
        yield p, part, *tree.nearest(part)


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``c0`` (the id), ``c1`` (the label) and ``v``: ``floor(scale * x)`` of every component of the usable vectors, stored."""
    x = F.col("x")
    given = vectors.select(named(id_col).alias("c0"), named(label_col).alias("c1"), named(vector_col).cast("array<double>").alias("x"))
    fit = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = stored(given.where(fit).select("c0", "c1", F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v")), "codes-vectors")
    first = rows.orderBy(F.col("c0").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    return rows if first is None else rows.where(F.size("v") == first.n)


def train_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks of ``whole_vectors`` as ``(part, entry, place)``. They begin as the vectors of the smallest ids; an entry
    that no part uses stays. Without rows there are none. The driver holds ``entries`` vectors and their sums."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    first = [r.v for r in rows.orderBy(F.col("c0").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not first:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    width = len(first[0])
    length = width // parts
    books = np.array(first, dtype=np.int64).reshape(len(first), parts, length).transpose(1, 0, 2).copy()

    for _ in range(rounds):
        now = books

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = [Tree(b) for b in now]
            k = now.shape[1]
            sums, counts = np.zeros((parts, k, length), dtype=object), np.zeros((parts, k), dtype=np.int64)
            for batch in batches:
                for p, part, index, _ in _found(_matrix(batch.column(0), width), trees, length):
                    part = wide(part, max(1, len(part)))
                    for e in np.unique(index):
                        sums[p, e] += part[index == e].sum(axis=0)
                    counts[p] += np.bincount(index, minlength=k)
            p, e, place = (v.ravel() for v in np.indices(sums.shape))
            used = np.flatnonzero(counts[p, e])
            total = pa.array([Decimal(int(v)) for v in sums.ravel()[used]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(v[used], pa.int32()) for v in (p, e, place)] + [total, pa.array(counts[p, e][used], pa.int64())], names=["p", "e", "place", "total", "n"])

        added = rows.select("v").mapInArrow(gather, "p int, e int, place int, total decimal(38,0), n long").groupBy("p", "e", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in added.collect():
            books[r.p, r.e, r.place] = int(r.total) // r.n
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(code: str, books: np.ndarray) -> list[int]:
    """The whole numbers that a code stands for."""
    return [int(v) for p in range(len(books)) for v in books[p, int(code[2 * p : 2 * p + 2], 16)]]


def encode_vectors(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``c0, c1, code, error`` of every row of ``whole_vectors``: the indexes of its parts' entries, two hex digits each, and
    the squared distances to them in all. An error beyond 63 bits is an OverflowError."""
    parts, _, length = books.shape
    width = parts * length
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, parts), dtype=np.uint8), np.zeros(batch.num_rows, dtype=object)
            for p, _, index, best in _found(_matrix(batch.column(2), width), trees, length):
                codes[:, p] = index
                errors += best
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()), pa.array([int(v) for v in errors], pa.int64())], names=["c0", "c1", "code", "error"])

    return rows.select("c0", "c1", "v").mapInArrow(run, f"c0 {kinds['c0']}, c1 {kinds['c1']}, code string, error long")


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS) -> DataFrame:
    """``<id_col>, <label_col>, code, error, label_error, codebooks_sha256`` of every usable vector.

    Rows go whose vector is null or holds null or non-finite components, is empty or can't be cut into equal parts, or
    has another length than that of the smallest usable id (nulls last; of equal ids the smaller vector). Ties go to the
    lower entry. Rows that repeat stay rows of their own; null labels count as one label, a null id is kept. Fewer
    vectors than ``entries`` give smaller codebooks, no rows give no rows. Components whose whole number doesn't fit 63
    bits are an error. Other columns are ignored, whatever their names.
    """
    ship(vectors.sparkSession)
    rows = whole_vectors(vectors, id_col, vector_col, label_col, parts, scale)
    books = train_codebooks(rows, parts, entries, rounds)
    made = stored(encode_vectors(rows, books).withColumn("own", F.coalesce(F.concat(F.lit("="), F.col("c1").cast("string")), F.lit(""))), "codes")
    sums = made.groupBy("own").agg(F.sum("error").alias("label_error"))
    out = salted_join(made, sums, "own", most=1 << 16, name="codes")
    return out.select(F.col("c0").alias(id_col), F.col("c1").alias(label_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _oracle() -> str:
    """Every round as a query over the one before it; entries of a part by index."""
    steps = [
        """rows AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(4096 * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM rows, range(8) t(p))",
        "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM cut QUALIFY e < 16)",
    ]
    near = "SELECT c.vec_id, c.label, c.p, c.x, b.e, list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut c JOIN b{k} b USING (p) QUALIFY row_number() OVER (PARTITION BY c.vec_id, c.p ORDER BY d, b.e) = 1"
    for k in range(ROUNDS):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        steps.append(f"m{k} AS MATERIALIZED (SELECT p, e, list(y ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(x[i]) / count(*))::BIGINT AS y FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (p, e))")
    steps.append(f"done AS MATERIALIZED ({near.format(k=ROUNDS)})")
    steps.append("codes AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM done GROUP BY vec_id, label)")
    steps.append(f"book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM codes, book"


ORACLE = _oracle()
