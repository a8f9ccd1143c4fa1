"""Hybrid search as one lazy plan: candidates by BM25 and distance, fusion, and late reading of the few rows shown."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fts import sanitized
from ..functions.text import excerpt, glob
from ..operators.blocks import BlockIndex, plain_words, top_query
from ..operators.dense import nearest
from ..operators.fusion import fuse, fused_order, single_pool
from ..operators.ivf import IvfIndex
from ..operators.lexical import bm25, bm25_postings, rank_bm25

MODES = ("hybrid", "bm25", "dense")


@dataclass(frozen=True)
class Filters:
    """Equality on language and kind, a glob on paths; None asks for nothing."""

    lang: str | None = None
    kind: str | None = None
    path_glob: str | None = None

    def columns(self) -> list[Column]:
        out = []
        if self.lang is not None:
            out.append(F.col("language") == self.lang)
        if self.kind is not None:
            out.append(F.col("kind") == self.kind)
        if self.path_glob is not None:
            out.append(glob(F.col("path"), self.path_glob))
        return out

    def condition(self) -> Column | None:
        out = None
        for c in self.columns():
            out = c if out is None else out & c
        return out


@dataclass
class Searcher:
    """``chunks`` and ``vectors`` (``chunk_id, embedding``) of an index; ``postings`` and ``stats`` where it has them, and
    ``blocks``, by which unfiltered searches for words read the blocks only that can hold a result. ``near``, an index of the
    vectors of chunks, gives unfiltered searches by L2 distance what its cells hold: nearly all of the true pool."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    encode: Callable[[str], Sequence[float]] | None = None
    postings: DataFrame | None = None
    stats: DataFrame | None = None
    metric: str = "l2"
    blocks: BlockIndex | None = None
    near: IvfIndex | None = None

    def lexical_pool(self, query: str, k: int, filters: Filters) -> DataFrame:
        where = filters.condition()
        words = plain_words(query) if self.blocks is not None and where is None else None
        if words is not None:
            return top_query(self.blocks, words[0], k, words[1])
        if self.postings is None:
            return rank_bm25(bm25(self.chunks, query, where), k)
        allowed = None if where is None else self.chunks.where(where).select("id")
        return rank_bm25(bm25_postings(self.postings, self.stats, query, allowed), k)

    def dense_pool(self, query: str, k: int, filters: Filters, when: str = "pre") -> DataFrame:
        """``when``: whether filters apply before the nearest ``k`` are cut (``pre``) or to those only (``post``)."""
        vector = self.encode(query)
        where = filters.condition()
        if self.near is not None and where is None and self.metric == "l2":
            asked = self.near.blocks.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "query long, embedding array<double>")
            return self.near.search(asked, k).select("id", "distance", "rank")
        kept = self.vectors.join(self.chunks.select("id") if where is None else self.chunks.where(where).select("id"), self.vectors.chunk_id == F.col("id"), "left_semi")
        if when == "pre":
            return nearest(kept, vector, k, self.metric)
        cut = nearest(self.vectors, vector, k, self.metric)
        allowed = self.chunks.select("id") if where is None else self.chunks.where(where).select("id")
        return cut.join(allowed, "id", "left_semi").drop("rank").withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")).cast("long"))

    def candidates(self, query: str, mode: str = "hybrid", bm25_k: int = 100, dense_k: int = 100, filters: Filters | None = None, dense_filter: str = "pre", sanitize: bool = False) -> DataFrame:
        """``id, score, bm25_rank, dense_rank`` of the pool or pools."""
        if mode not in MODES:
            raise ValueError(f"no such mode: {mode}")
        if mode != "bm25" and (self.encode is None or self.vectors is None):
            raise ValueError(f"mode {mode} needs an embedding backend")
        filters = filters or Filters()
        words = sanitized(query) if sanitize else query
        none = F.lit(None).cast("long")
        if mode == "bm25":
            return single_pool(self.lexical_pool(words, bm25_k, filters)).select("id", "score", F.col("order").alias("bm25_rank"), none.alias("dense_rank"))
        near = self.dense_pool(query, dense_k, filters, dense_filter)
        if mode == "dense":
            return single_pool(near).select("id", "score", none.alias("bm25_rank"), F.col("order").alias("dense_rank"))
        return fuse(self.lexical_pool(words, bm25_k, filters), near)

    def hydrate(self, scored: DataFrame, k: int) -> DataFrame:
        """The best ``k`` of ``scored`` with their chunk's columns; ids without a chunk drop out. Wide columns are read for
        these rows only: the cut is small, so it is the side that Spark broadcasts."""
        best = scored.orderBy(*fused_order()).limit(k)
        rows = self.chunks.join(F.broadcast(best), "id")  # k rows at most
        shown = rows.select("id", "path", "start_line", "end_line", "language", "kind", "name", "scope", excerpt(F.col("content")).alias("excerpt"), "score", "bm25_rank", "dense_rank")
        return shown.orderBy(*fused_order())

    def search(self, query: str, mode: str = "hybrid", k: int = 20, bm25_k: int = 100, dense_k: int = 100, filters: Filters | None = None, explain: bool = False, **more) -> DataFrame:
        """Result rows, best first: ``path, start_line, end_line, language, kind, name, scope, excerpt, score`` and, if
        ``explain``, the rank in each pool. No match is an empty result."""
        if min(k, bm25_k, dense_k) < 1:
            raise ValueError("k, bm25_k and dense_k must be at least 1")
        out = self.hydrate(self.candidates(query, mode, bm25_k, dense_k, filters, **more), k)
        return out if explain else out.drop("id", "bm25_rank", "dense_rank")
