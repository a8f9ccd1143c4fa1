"""A lexical index that is kept current at a cost in proportion to what changed.

The index is four tables partitioned by segment: chunks, postings in blocks, the dictionary, and tombstones. A change writes
one new segment with the new chunks only, and a tombstone for each chunk that it replaces, with the words that the
chunk takes out of the statistics. Nothing that was written is touched again. A version of the manifest then lists the
segments that live; it is one file that appears at once, so readers see a change whole or not at all, and what a failed
change has left is listed nowhere.

Searches read all live segments as one table. Counts of chunks and words are sums over the manifest, counts of a term are
summed over its rows of the dictionary less those of tombstones, so scores are those of an index built anew. Where
``FANOUT`` segments of a size have gathered they are merged without reading a text again; each chunk is rewritten once
for each size that it passes through.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.fts import COLUMNS
from ..functions.text import tokens
from ..operators.blocks import BlockIndex, bucket, gathered, gathered_texts, scattered, words
from ..runtime import stored

FANOUT, BASE = 4, 1000
#: Parts of the chunk table by path: a change reads those of its own paths.
SHARDS = 64
#: Bits that ids leave to the number of a segment in a bucket's key.
_RANGE = 40

_CHUNKS = "id long, path string, name string, scope string, content string, dl long, segment string, shard int"
_BLOCKS = "term string, bucket long, n long, impact double, avgdl double, ids array<long>, tfs array<long>, dls array<long>, segment string"
_WORDS = "term string, docs long, peak double, low double, segment string"
_DEAD = "id long, dl long, terms array<string>, change string, segment string"
_MANIFEST = "kind string, segment string, change string, rows long, tokens long, last_id long, version long"


@dataclass(frozen=True)
class Part:
    """A row of the manifest: a segment, or the tombstones of one change in one segment."""

    kind: str
    segment: str
    change: str
    rows: int
    tokens: int
    last_id: int


def level(rows: int) -> int:
    """Segments of a level differ by a factor below ``FANOUT``."""
    return max(0, math.floor(math.log(max(rows, 1) / BASE, FANOUT)) + 1) if rows >= BASE else 0


class SegmentStore:
    """Tables below ``root``, a folder that driver and executors share; any path that Spark writes will do. One writer at a
    time; readers are never in the way."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame, table: str, *parts: str) -> None:
        rows.write.mode("append").partitionBy(*parts).parquet(f"{self.root}/{table}")

    # --- the manifest -------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(r.version for r in self._read("manifest", _MANIFEST).select("version").distinct().collect())

    def manifest(self, version: int | None = None) -> tuple[int, list[Part]]:
        """The number of a version, the newest unless given, and its parts: as many as there are segments and changes since
        their merge. 0 and none before the first change."""
        rows = self._read("manifest", _MANIFEST)
        if version is None:
            version = rows.agg(F.max("version")).first()[0]
        if version is None:
            return 0, []
        return version, [Part(*r[:6]) for r in rows.where(F.col("version") == version).collect() if r.kind != "none"]

    def _commit(self, version: int, parts: list[Part]) -> int:
        # an index without chunks has a version too
        rows = [(p.kind, p.segment, p.change, p.rows, p.tokens, p.last_id) for p in parts] or [("none", "", "", 0, 0, 0)]
        made = self.spark.createDataFrame(rows, _MANIFEST.removesuffix(", version long")).coalesce(1).withColumn("version", F.lit(version + 1).cast("long"))
        self._append(made, "manifest", "version")
        return version + 1

    # --- reading ------------------------------------------------------------------------------------------------------

    def _of(self, table: str, schema: str, names: list[str]) -> DataFrame:
        return self._read(table, schema).where(F.col("segment").isin(names) if names else F.lit(False))

    def _tombstones(self, parts: list[Part], names: list[str] | None = None) -> DataFrame:
        """Tombstones of the manifest in some segments, all unless given."""
        own = [p for p in parts if p.kind == "dead" and (names is None or p.segment in names)]
        if not own:
            return self.spark.createDataFrame([], _DEAD)
        # a change that is listed is listed with all its segments that live
        return self._read("dead", _DEAD).where(F.col("segment").isin(sorted({p.segment for p in own})) & F.col("change").isin(sorted({p.change for p in own})))

    def chunks(self, version: int | None = None) -> DataFrame:
        """``id, path, name, scope, content, dl, segment, shard`` of the chunks that live."""
        _, parts = self.manifest(version)
        return self._live(parts)

    def _live(self, parts: list[Part], names: list[str] | None = None) -> DataFrame:
        found = self._of("chunks", _CHUNKS, [p.segment for p in parts if p.kind == "segment"] if names is None else names)
        return found.join(self._tombstones(parts, names).select("id"), "id", "left_anti")

    @staticmethod
    def _totals(parts: list[Part]) -> tuple[int, int]:
        sign = {"segment": 1, "dead": -1}
        return sum(sign[p.kind] * p.rows for p in parts), sum(sign[p.kind] * p.tokens for p in parts)

    def index(self, version: int | None = None) -> BlockIndex:
        """The live segments as one index. A bucket is a segment's own: its key gets the segment's place in the manifest."""
        _, parts = self.manifest(version)
        names = [p.segment for p in parts if p.kind == "segment"]
        n, tokens = self._totals(parts)
        place = F.create_map(*[F.lit(x) for k, s in enumerate(names) for x in (s, k)])[F.col("segment")] if names else F.lit(0)
        own = lambda key: key + F.shiftleft(place.cast("long"), _RANGE)
        blocks = self._of("blocks", _BLOCKS, names).withColumn("bucket", own(F.col("bucket"))).drop("segment")
        dead = self._tombstones(parts)
        said = self._of("dictionary", _WORDS, names).select("term", "docs", "peak", "low")
        less = dead.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("docs"), F.lit(None).cast("double").alias("peak"), F.lit(None).cast("double").alias("low"))
        merged = said.unionAll(less).groupBy("term").agg(F.sum("docs").alias("docs"), F.max("peak").alias("peak"), F.min("low").alias("low")).where("docs > 0")
        stats = self.spark.createDataFrame([(n, tokens / n if n else None)], "n long, avgdl double")
        gone = dead.select("id", own(bucket(F.col("id"), F.col("dl"))).alias("bucket")) if any(p.kind == "dead" for p in parts) else None
        return BlockIndex(blocks, merged, stats, gone)

    # --- changing -----------------------------------------------------------------------------------------------------

    def next_id(self) -> int:
        """An id above all that were ever used."""
        return max((p.last_id for p in self.manifest()[1]), default=0) + 1

    def _write(self, blocks: DataFrame, name: str, texts: DataFrame) -> None:
        """``blocks``, their dictionary and the chunks ``texts`` as the segment ``name``."""
        segment = F.lit(name).alias("segment")
        self._append(texts.select("id", "path", "name", "scope", "content", "dl", segment, _shard().alias("shard")).repartition("shard").sortWithinPartitions("shard", "path"), "chunks", "segment", "shard")
        self._append(blocks.withColumn("segment", segment), "blocks", "segment")
        made = self._of("blocks", _BLOCKS, [name]).drop("segment")
        self._append(words(made).withColumn("segment", segment), "dictionary", "segment")

    def change(self, chunks: DataFrame, gone: DataFrame | None = None) -> int:
        """Takes in ``chunks`` (``id, path, name, scope, content``; ids that were never used) in place of all chunks of their
        paths, and takes out the chunks of the paths of ``gone``. Returns the new version.

        Reads the new chunks, the parts of the chunk table where changed paths lie, and the manifest; writes one segment and
        the tombstones. Empty inputs are fine; repeated paths in ``gone`` count once.
        """
        version, parts = self.manifest()
        name = f"{version + 1:09d}-{uuid.uuid4().hex[:8]}"
        sized = stored(chunks.select("id", "path", "name", "scope", "content", _length().alias("dl")), "segment-chunks")
        paths = sized.select("path") if gone is None else sized.select("path").unionAll(gone.select("path"))
        paths = stored(paths.where("path IS NOT NULL").distinct(), "segment-paths")
        dead, tombs = self._bury(parts, paths, name)
        facts = sized.agg(F.count("*").alias("rows"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"), F.coalesce(F.max("id"), F.lit(0)).alias("last_id")).first()
        made = [*parts, *tombs] + [Part("segment", name, name, facts.rows, facts.tokens, facts.last_id)] * bool(facts.rows)
        n, tokens = self._totals(made)
        if facts.rows:
            self._write(gathered_texts(sized, tokens / n if tokens else 1.0), name, sized)
        if tombs:
            self._append(dead, "dead", "change", "segment")
        return self._commit(version, made)

    def _bury(self, parts: list[Part], paths: DataFrame, change: str) -> tuple[DataFrame, list[Part]]:
        """Tombstones for the live chunks of ``paths``, and their parts of the manifest."""
        shards = [r.shard for r in paths.select(_shard().alias("shard")).distinct().collect()]  # SHARDS at most
        old = self._live(parts).where(F.col("shard").isin(shards) if shards else F.lit(False)).join(paths, "path", "left_semi")
        old = stored(old.select("id", "path", "name", "scope", "content", "dl", "segment"), "segment-victims")
        rows = old.select("id", "dl", F.array_distinct(F.concat(*[tokens(F.col(c)) for c in COLUMNS])).alias("terms"), F.lit(change).alias("change"), "segment")
        sums = old.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"), F.max("id").alias("last_id")).collect()  # a row per segment
        return rows, [Part("dead", r.segment, change, r.n, r.tokens, r.last_id) for r in sums]

    def compact(self) -> int:
        """Merges segments of a level wherever ``FANOUT`` have gathered, until nowhere. Returns the version."""
        while True:
            version, parts = self.manifest()
            levels: dict[int, list[Part]] = {}
            for p in parts:
                if p.kind == "segment":
                    levels.setdefault(level(p.rows), []).append(p)
            full = next((levels[k] for k in sorted(levels) if len(levels[k]) >= FANOUT), None)
            if full is None:
                return version
            self._merge(version, parts, full)

    def _merge(self, version: int, parts: list[Part], merged: list[Part]) -> int:
        names = [p.segment for p in merged]
        name = f"{version + 1:09d}-{uuid.uuid4().hex[:8]}"
        dead = self._tombstones(parts, names).select("id")
        texts = self._live(parts, names)
        rows = scattered(self._of("blocks", _BLOCKS, names)).join(dead, "id", "left_anti")
        n, tokens = self._totals([p for p in parts if p.segment in names])
        stay = [p for p in parts if p.segment not in names]
        whole = self._totals(parts)
        if n:
            blocks = gathered(rows.select("term", "id", "dl", "tf", F.lit(whole[1] / whole[0] if whole[1] else 1.0).alias("avgdl")))
            self._write(blocks.repartitionByRange("term", F.desc("impact")).sortWithinPartitions("term", F.desc("impact")), name, texts)
        last = max(p.last_id for p in parts if p.segment in names)
        # a level whose chunks are all dead leaves an empty segment, which keeps the last id
        return self._commit(version, [*stay, Part("segment", name, name, n, tokens, last)])


def _length():
    return sum((F.size(tokens(F.col(c))) for c in COLUMNS[1:]), F.size(tokens(F.col(COLUMNS[0])))).cast("long")


def _shard():
    return F.pmod(F.xxhash64("path"), F.lit(SHARDS)).cast("int")
