"""Symbol look-ups and the edge graph. Rows aren't made distinct: two edges to one target are two rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_substring
from ..runtime import stored
from .changes import assign_ids
from .skew import salted_join
from .trigrams import NameIndex


def _named(column: Column, name: str, exact: bool) -> Column:
    return column == name if exact else like_substring(column, name)


def symbols(symbols_: DataFrame, chunks: DataFrame, name: str, kind: str = "def", exact: bool = False, language: str | None = None, names: NameIndex | None = None) -> DataFrame:
    """``path, scope, language, name, line`` of symbols whose name is, or contains, ``name``, by path and line. ``names``, an
    index of the symbols' names, spares reading all of them."""
    if kind not in ("def", "ref"):
        raise ValueError(f"no such kind: {kind}")
    named = symbols_.where(_named(F.col("name"), name, exact)) if names is None or exact else names.rows(symbols_, name)
    found = named.where(F.col("kind") == kind).select(F.col("id").alias("_symbol"), "chunk_id", "name", "line")
    own = chunks if language is None else chunks.where(F.col("language") == language)
    out = found.join(own.select(F.col("id").alias("chunk_id"), "path", "scope", "language"), "chunk_id")
    return out.orderBy("path", "line", "_symbol").select("path", "scope", "language", "name", "line")


def callers(edges: DataFrame, chunks: DataFrame, symbol: str, exact: bool = False, language: str | None = None, resolve: DataFrame | None = None, names: NameIndex | None = None) -> DataFrame:
    """``path, scope, language, start_line, kind, dst_name`` of edges to ``symbol``, by path and line. ``resolve``, a
    symbols table, adds ``resolved``: whether the target is defined there. ``names``: an index of the edges' targets."""
    named = edges.where(_named(F.col("dst_name"), symbol, exact)) if names is None or exact else names.rows(edges, symbol, "dst_name")
    found = named.select("src_chunk_id", "dst_name", F.col("kind").alias("_kind"))
    own = chunks if language is None else chunks.where(F.col("language") == language)
    out = found.join(own.select(F.col("id").alias("src_chunk_id"), "path", "scope", "language", "start_line"), "src_chunk_id")
    shown = ["path", "scope", "language", "start_line", F.col("_kind").alias("kind"), "dst_name"]
    if resolve is not None:
        defined = resolve.where("kind = 'def'").select(F.col("name").alias("dst_name")).distinct().withColumn("resolved", F.lit(True))
        out = out.join(defined, "dst_name", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
        shown.append("resolved")
    return out.orderBy("path", "start_line", "dst_name").select(*shown)


def deps(edges: DataFrame, chunks: DataFrame, path: str, language: str | None = None) -> DataFrame:
    """``path, kind, dst_name, meta`` of the edges that leave the file ``path``, exactly."""
    own = chunks.where(F.col("path") == path)
    own = own if language is None else own.where(F.col("language") == language)
    out = edges.join(own.select(F.col("id").alias("src_chunk_id"), "path"), "src_chunk_id")
    return out.orderBy("path", "kind", "dst_name").select("path", "kind", "dst_name", "meta")


def unresolved(edges: DataFrame, symbols_: DataFrame) -> DataFrame:
    """Edges whose target no symbol defines."""
    defined = symbols_.where("kind = 'def'").select(F.col("name").alias("dst_name"))
    return edges.join(defined, "dst_name", "left_anti").select("src_chunk_id", "dst_name", "kind")


def reachable(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``node, depth``: nodes within ``depth`` steps of ``start`` (``node``) over ``links`` (``src, dst``), each at its least
    depth. A join a step; nodes seen before leave the frontier."""
    seen = start.select("node", F.lit(0).alias("depth")).distinct()
    front = seen.select("node")
    for step in range(1, depth + 1):
        front = links.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(step)))
    return seen


#: Sources to a row of a walk: so many longs of 64 bits, one for each source.
LONGS = 8


def _any_bit() -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"_m{k}") != 0 for k in range(LONGS)])


def walk(links: DataFrame, sources: DataFrame, name: str = "closure") -> tuple[DataFrame, DataFrame]:
    """The distinct ``sources`` (``node``) with their ``id`` from 0 on in their order; and ``node, block, depth`` with the bits
    ``_m0`` and so on of the sources of the block, ``64 * LONGS`` of them, that reach the node first at ``depth``."""
    ways = stored(links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct(), f"{name}-links").withColumnRenamed("src", "node")
    numbered = stored(assign_ids(sources.where("node IS NOT NULL").select("node").distinct(), ["node"], 0), f"{name}-sources")
    at, masks = F.col("id") % (64 * LONGS), [f"_m{k}" for k in range(LONGS)]
    bit = F.expr("shiftleft(1L, cast(id % 64 as int))")
    first = numbered.select("node", F.floor(F.col("id") / (64 * LONGS)).alias("block"), *[F.when(F.floor(at / 64) == k, bit).otherwise(0).alias(m) for k, m in enumerate(masks)])
    seen = front = stored(first.withColumn("depth", F.lit(0)), name)
    depth = 0
    while not front.isEmpty():
        depth += 1
        met = salted_join(front.drop("depth"), ways, "node", most=8, name=name).groupBy(F.col("dst").alias("node"), "block").agg(*[F.bit_or(m).alias(m) for m in masks])
        old = seen.groupBy("node", "block").agg(*[F.bit_or(m).alias(f"_o{m}") for m in masks])
        new = met.join(old, ["node", "block"], "left").select("node", "block", *[F.col(m).bitwiseAND(F.bitwise_not(F.coalesce(f"_o{m}", F.lit(0).cast("long")))).alias(m) for m in masks])
        front = stored(new.where(_any_bit()).withColumn("depth", F.lit(depth)), name)
        seen = seen.unionByName(front)
        if depth % 8 == 0:
            seen = stored(seen, name)
    return numbered, seen


def by_long(seen: DataFrame) -> DataFrame:
    """``node, depth, _long, _bits``: the bits of a walk, 64 sources to a row."""
    longs = seen.select("node", "depth", "block", F.posexplode(F.array(*[f"_m{k}" for k in range(LONGS)])).alias("k", "_bits")).where("_bits <> 0")
    return longs.select("node", "depth", "_bits", (F.col("block") * LONGS + F.col("k")).alias("_long"))


def closure(links: DataFrame, sources: DataFrame, name: str = "closure") -> DataFrame:
    """``source, node, depth``: every node that can be reached from each of ``sources`` (``node``) over ``links`` (``src, dst``),
    the source itself at 0, each at its least depth; cycles are walked once.

    Sources are numbered in their order, and a row holds a node with the bits of ``64 * LONGS`` sources that have just reached
    it, so a round follows a link once for so many of them. Semi-naive: a round joins only the bits that the last one
    found, and those seen before leave; rows become pairs in the result only. Each round's rows are
    written, so lineage stays short and a lost executor repeats one round; rounds are as many as the longest of all
    shortest ways. A node in which very many ways meet is dealt to parts. Null nodes and links are ignored.
    """
    numbered, seen = walk(links, sources, name)
    own = numbered.groupBy(F.floor(F.col("id") / 64).alias("_long")).agg(F.sort_array(F.collect_list(F.struct("id", "node"))).alias("own"))
    pairs = by_long(seen).join(own.select("_long", F.col("own.node").alias("own")), "_long").select("node", "depth", "_bits", F.posexplode("own").alias("k", "source"))
    return pairs.where(F.expr("getbit(_bits, k) = 1")).select("source", "node", "depth")
