"""Building an index of a source tree, and keeping it current."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.embedding import Backend
from ..operators import changes
from ..operators.lexical import corpus_stats, postings
from ..parsers.registry import parse_files
from ..runtime import ship, stored
from ..sources.store import IndexStore, Snapshot, check_model
from ..sources.walk import Listed, list_files, listing, read_files, with_projects


@dataclass
class Tree:
    """What is indexed: the root, and what a config says of it."""

    root: str | Path
    project: str = "project"
    ignores: Sequence[str] = ()
    roots: Sequence[str] = (".",)
    extensions: dict[str, str] | None = None
    extra: Sequence[str] = ()
    batch_size: int = 16

    def files(self) -> list[Listed]:
        return with_projects(list(list_files(self.root, self.ignores, self.extensions, self.roots)))


@dataclass
class BuildResult:
    files_walked: int = 0
    files_chunked: int = 0
    files_failed: int = 0
    chunks: int = 0
    symbols: int = 0
    edges: int = 0
    seconds: float = 0.0
    dry_run: bool = False


@dataclass
class SyncResult:
    added: int = 0
    changed: int = 0
    unchanged: int = 0
    removed: int = 0
    chunks_total: int = 0
    seconds: float = 0.0

    def as_dict(self) -> dict:
        return asdict(self)


def parsed(spark: SparkSession, tree: Tree, files: list[Listed]) -> DataFrame:
    """Parses ``files`` once, in the shared folder: chunks, symbols and edges are three views of it."""
    return stored(parse_files(read_files(spark, files), tree.extra), "parsed")


def tables(found: DataFrame, tree: Tree, backend: Backend, next_id: int = 1) -> dict[str, DataFrame]:
    """The index tables of parsed files; ids count from ``next_id`` in the order of paths and places. Symbols and edges
    hang on their file's first chunk, so those of files without chunks are dropped."""
    good = found.where("error IS NULL")
    rows = good.select("path", "language", F.posexplode("chunks").alias("ordinal", "c")).select("path", "language", "ordinal", F.lit(tree.project).alias("project"), "c.*")
    chunks = stored(changes.assign_ids(rows, ["path", "ordinal"], next_id), "chunks")
    first = changes.first_chunk(chunks)
    said = good.select("path", F.posexplode("symbols").alias("ordinal", "s")).select("path", "ordinal", "s.*").join(first, "path")
    symbols = changes.assign_ids(said, ["path", "ordinal"], next_id)
    edges = good.select("path", F.explode("edges").alias("e")).join(first, "path").select(F.col("chunk_id").alias("src_chunk_id"), F.col("e.target").alias("dst_name"), F.col("e.kind").alias("kind"), F.col("e.meta").alias("meta"))
    vectors = chunks.select(F.col("id").alias("chunk_id"), backend.column(F.col("content"), tree.batch_size).alias("embedding"))
    return {"chunks": chunks, "symbols": symbols, "edges": edges, "embeddings": vectors, "files": good.select("path", "mtime", "size")}


def _with_index(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return parts | {"postings": postings(parts["chunks"]), "stats": corpus_stats(parts["chunks"])}


def _moved_index(old: Snapshot, new: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Postings and statistics after a sync, at the cost of the texts that came and went: other chunks' rows are kept as they
    are. ``new``: the chunks that came; ``gone``: paths whose chunks went."""
    victims = stored(changes.victims(old.table("chunks"), gone), "victims")
    kept = old.table("postings").join(victims.select("id"), "id", "left_anti")
    came = stored(postings(new), "new-postings")
    was, less, more = (df.withColumn("tokens", F.coalesce(F.round(F.col("n") * F.col("avgdl")), F.lit(0)).cast("long")).first() for df in (old.table("stats"), corpus_stats(victims), corpus_stats(new)))
    n, tokens = was.n - less.n + more.n, was.tokens - less.tokens + more.tokens
    stats = new.sparkSession.createDataFrame([(n, tokens / n if n else None)], "n long, avgdl double")
    return {"postings": kept.select(*came.columns).unionByName(came), "stats": stats}


def _meta(backend: Backend, next_id: int) -> dict[str, str]:
    return {"engine_version": __version__, "embed_model": backend.name, "embed_dim": str(backend.dim), "embed_device": backend.device, "next_id": str(next_id)}


def build(store: IndexStore, tree: Tree, backend: Backend, dry_run: bool = False) -> BuildResult:
    """Indexes the tree anew. A dry run parses and counts, and writes nothing."""
    began = time.monotonic()
    spark = ship(store.spark)
    files = tree.files()
    found = parsed(spark, tree, files)
    n = found.agg(
        F.count("*").alias("read"), F.count("error").alias("failed"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size("chunks"))), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum(F.when(F.size("chunks") > 0, F.size("symbols"))), F.lit(0)).alias("symbols"), F.coalesce(F.sum(F.when(F.size("chunks") > 0, F.size("edges"))), F.lit(0)).alias("edges"),
    ).first()
    result = BuildResult(n.read, n.read - n.failed, n.failed, n.chunks, n.symbols, n.edges, 0.0, dry_run)
    if not dry_run:
        start = int(store.open(check_version=False).meta.get("next_id", 1)) if store.exists() else 1
        store.write(_with_index(tables(found, tree, backend, start)), _meta(backend, start + max(n.chunks, n.symbols)))
    result.seconds = time.monotonic() - began
    return result


def sync(store: IndexStore, tree: Tree, backend: Backend) -> SyncResult:
    """Brings the index up to date. Files are told by exact time and size before any is read; only new and changed ones are
    parsed. One that doesn't parse keeps its rows and counts as unchanged. Other rows keep their ids, and no id is used again."""
    began = time.monotonic()
    spark = ship(store.spark)
    old = store.open()
    check_model(old.meta, backend.name, backend.dim)
    files = tree.files()
    status = stored(changes.classify(old.table("files"), listing(spark, files)), "status")
    fresh = {r.path: r.status for r in status.where("status IN ('added', 'changed')").collect()}
    found = parsed(spark, tree, [f for f in files if f.rel_path in fresh])
    good = found.where("error IS NULL").select("path")
    bad = status.where("status = 'changed'").select("path").join(good, "path", "left_anti").select("path").distinct()
    kept_back = {r.path for r in bad.collect()}
    gone = status.where("status = 'removed'").select("path").unionByName(good)
    next_id = int(old.meta["next_id"])
    new = tables(found, tree, backend, next_id)
    merged = _merge(old, new, gone)
    used = max((int(r.m or 0) for r in (new["chunks"].agg(F.max("id").alias("m")).first(), new["symbols"].agg(F.max("id").alias("m")).first())), default=0)
    now = store.write(merged | _moved_index(old, new["chunks"], gone), _meta(backend, max(next_id, used + 1)))
    n = changes.counts(status).first()
    failed_new = sum(1 for p, s in fresh.items() if s == "added") - good.join(status.where("status = 'added'").select("path"), "path", "left_semi").count()
    return SyncResult(n.added - failed_new, n.changed - len(kept_back), n.unchanged + len(kept_back), n.removed, now.table("chunks").count(), time.monotonic() - began)


def _merge(old: Snapshot, new: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    chunks = old.table("chunks")
    stay = changes.survivors(chunks, gone)
    ids = stay.select(F.col("id").alias("chunk_id"))
    pick = lambda name, key: old.table(name).join(ids.withColumnRenamed("chunk_id", key), key, "left_semi")
    both = lambda name, rows: rows.select(*old.table(name).columns).unionByName(new[name].select(*old.table(name).columns))
    return {
        "chunks": both("chunks", stay),
        "symbols": both("symbols", pick("symbols", "chunk_id")),
        "edges": both("edges", pick("edges", "src_chunk_id")),
        "embeddings": both("embeddings", pick("embeddings", "chunk_id")),
        "files": changes.survivors(old.table("files"), gone).unionByName(new["files"]),
    }
