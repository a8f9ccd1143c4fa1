"""Postings in blocks, and the best rows of a query without reading blocks that can't hold any.

A block holds a term's postings in one bucket: chunks of about one length (a quarter of an octave) whose ids lie in one range
of ``SPAN``. Its head says the largest impact of its postings, the part of BM25 that a term's count and the chunk's
length give. Since buckets are the same for all terms, a query's heads add up to a bound on the score of any chunk of a
bucket, by an aggregate over narrow rows. An impact is also some chunk's, so the ``k``-th best of the buckets' largest is a
score that ``k`` chunks reach; the buckets with the best bounds are opened first and may raise it. Of the others only
those are opened whose bound reaches this threshold. The result is exactly that of scoring
every posting: a bucket that is left out holds no chunk that could be among the best.

Blocks are sorted by term and impact, so the filters on both, which are pushed to the scan, skip pages of a common term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fts import COLUMNS, Node, parse
from ..functions.text import tokens
from ..runtime import ship, stored
from .lexical import B, K1, LEAST_IDF, OUT, coded, corpus_stats, lists
from .skew import salted_join

#: Ids to a bucket, and buckets that are opened to find the threshold (fewer where they hold enough chunks).
SPAN, FIRST = 1024, 64
#: Bytes of words that are gathered at a time.
BYTES = 16 << 20
#: Parts of scores are added as whole numbers of this part of one, so that no order of addition shows; bounds get the
#: benefit of it.
UNIT = 1e12


def impact(tf, dl, avgdl):
    """Of columns or of arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _total(part: Column) -> Column:
    return (F.sum(F.rint(part * UNIT).cast("long")) / UNIT).alias("score")


def _margin(terms):
    return (terms + 10) / UNIT


def idf(docs: Column, n: Column) -> Column:
    raw = F.log((n - docs + 0.5) / (docs + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def bucket(identity: Column, dl: Column) -> Column:
    octave = F.floor(F.log2(F.greatest(dl, F.lit(1)).cast("double")) * 4).cast("long")
    return F.shiftleft(octave, 52) + F.floor(identity / SPAN).cast("long")


def counted(postings: DataFrame) -> DataFrame:
    """``term, id, dl, tf``: places as counts over all columns."""
    tf = sum((F.size(c) for c in COLUMNS[1:]), F.size(COLUMNS[0])).cast("long")
    return postings.select("term", "id", "dl", tf.alias("tf"))


def gathered(rows: DataFrame) -> DataFrame:
    """Blocks of ``term, id, dl, tf, avgdl``."""
    found = F.array_sort(F.collect_list(F.struct("id", "tf", "dl")))
    made = rows.groupBy("term", bucket(F.col("id"), F.col("dl")).alias("bucket"), "avgdl").agg(F.count("*").alias("n"), F.max(impact(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("impact"), found.alias("p"))
    return made.select("term", "bucket", "n", "impact", "avgdl", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))


def gathered_texts(chunks: DataFrame, mean: float) -> DataFrame:
    """Blocks of ``chunks`` (``id`` and texts), as ``gathered`` makes them of their postings, with the mean length ``mean``.

    Only the texts are moved, to the others of their range of ids; words meet where they are cut. Blocks come in runs of about
    ``BYTES`` of words sorted by term and impact, so a stored table needs no sort."""
    ship(chunks.sparkSession)
    span = F.floor(F.col("id") / SPAN).cast("long")
    near = chunks.select(F.col("id").cast("long").alias("id"), *COLUMNS, span.alias("span")).repartition("span").sortWithinPartitions("span")
    said = near.select("span", "id", F.concat(*[tokens(F.col(c)) for c in COLUMNS]).alias("t"))
    rows = said.select("span", "id", bucket(F.col("id"), F.size("t")).alias("bucket"), "t")

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        said = table.column("t").combine_chunks()
        dl = pc.list_value_length(said).to_numpy(zero_copy_only=False).astype(np.int64)
        if not dl.sum():
            return
        words, code = coded(said.flatten())
        ids, own = (table.column(c).to_numpy() for c in ("id", "bucket"))
        order = np.lexsort((ids, own))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        key, tf = np.unique(code * len(ids) + np.repeat(place, dl), return_counts=True)
        term, row = key // len(ids), order[key % len(ids)]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (own[row[1:]] != own[row[:-1]])]))
        n = np.diff(np.append(first, len(key)))
        best = np.maximum.reduceat(impact(tf, dl[row], mean), first)
        held = [lists(n, v, pa.int64()) for v in (ids[row], tf, dl[row])]
        made = pa.RecordBatch.from_arrays([words.take(term[first]), pa.array(own[row[first]]), pa.array(n), pa.array(best), pa.array(np.full(len(n), mean)), *held], names=["term", "bucket", "n", "impact", "avgdl", "ids", "tfs", "dls"])
        made = made.take(pa.array(np.lexsort((-best, term[first]))))
        yield from (made.slice(k, OUT) for k in range(0, len(n), OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BYTES:
                table = pa.Table.from_batches(held)
                spans = table.column("span").to_numpy()
                cut = int(np.searchsorted(spans, spans[-1]))  # a range of ids stays whole
                if cut:
                    yield from blocks(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield from blocks(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "term string, bucket long, n long, impact double, avgdl double, ids array<long>, tfs array<long>, dls array<long>")


def scattered(blocks: DataFrame) -> DataFrame:
    """``term, id, tf, dl`` of blocks."""
    return blocks.select("term", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))


def words(blocks: DataFrame) -> DataFrame:
    """The dictionary of ``blocks``."""
    return blocks.groupBy("term").agg(F.sum("n").alias("docs"), F.max("impact").alias("peak"), F.min("avgdl").alias("low"))


@dataclass
class BlockIndex:
    """``blocks``: ``term, bucket, n, impact, avgdl, ids, tfs, dls``; ``dictionary``: ``term, docs`` and of its blocks the largest
    impact ``peak`` and the smallest ``avgdl`` ``low``; ``stats``: ``n, avgdl``. ``impact`` was made with the ``avgdl`` of its
    row and bounds scores by any other: see ``_head``."""

    blocks: DataFrame
    dictionary: DataFrame
    stats: DataFrame
    #: ``id, bucket`` of chunks that blocks still hold but results must not; the dictionary and stats are without them.
    dead: DataFrame | None = None

    @classmethod
    def of(cls, postings: DataFrame, stats: DataFrame) -> BlockIndex:
        """Lazy tables of an index's ``postings`` (``term, id, dl`` and places)."""
        avgdl = stats.select(F.coalesce("avgdl", F.lit(1.0)).alias("avgdl"))
        blocks = gathered(counted(postings).crossJoin(F.broadcast(avgdl)))  # one row
        return cls(blocks, words(blocks), stats)

    @classmethod
    def build(cls, chunks: DataFrame, name: str = "blocks") -> BlockIndex:
        """The stored index of ``chunks``, made of their texts."""
        stats = stored(corpus_stats(chunks), f"{name}-stats")
        blocks = stored(gathered_texts(chunks, stats.first().avgdl or 1.0), name)
        return cls(blocks, stored(words(blocks), f"{name}-dictionary"), stats)

    def stored(self, name: str = "blocks") -> BlockIndex:
        """The same tables, written and sorted."""
        blocks = stored(self.blocks.repartitionByRange("term", F.desc("impact")).sortWithinPartitions("term", F.desc("impact")), name)
        dictionary = stored(words(blocks).repartitionByRange("term").sortWithinPartitions("term"), f"{name}-dictionary")
        return BlockIndex(blocks, dictionary, stored(self.stats, f"{name}-stats"), self.dead)

    def alive(self, scored: DataFrame) -> DataFrame:
        return scored if self.dead is None else scored.join(self.dead.select("id"), "id", "left_anti")

    def certain(self, bounds: DataFrame) -> DataFrame:
        """``bounds`` whose ``sure`` is 0 for buckets with a dead chunk: theirs may be the largest impact."""
        if self.dead is None:
            return bounds
        marked = self.dead.select("bucket").distinct().withColumn("_dead", F.lit(True))
        return bounds.join(marked, "bucket", "left").withColumn("sure", F.when(F.col("_dead"), 0.0).otherwise(F.col("sure"))).drop("_dead")


def _head(mean: Column) -> Column:
    """The bound on a block's impacts for the mean length ``mean``: lengths count for less where the mean has grown, by
    the ratio of the means at most."""
    return F.col("impact") * F.greatest(F.lit(1.0), mean / F.col("avgdl"))


def _sure(mean: Column) -> Column:
    """What a chunk of the block reaches at least: lengths count for more where the mean is smaller."""
    return F.col("impact") * F.least(F.lit(1.0), mean / F.col("avgdl"))


def _open(asked: DataFrame, index: BlockIndex, terms: DataFrame, every: bool) -> DataFrame:
    """``query, id, score`` of the chunks of the buckets ``asked`` (``query, bucket``); ``terms``: ``query, term, idf, mean, terms``."""
    rows = asked.join(terms, "query").join(index.blocks.select("term", "bucket", "ids", "tfs", "dls"), ["term", "bucket"])
    each = rows.select("query", "idf", "mean", "terms", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
    part = F.col("idf") * impact(F.col("p.tfs"), F.col("p.dls"), F.col("mean"))
    scored = each.groupBy("query", F.col("p.ids").alias("id")).agg(_total(part), F.count("*").alias("held"), F.first("terms").alias("terms"))
    return index.alive((scored.where(F.col("held") == F.col("terms")) if every else scored).select("query", "id", "score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query; Spark cuts each partition's rows before they are moved."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def top_batch(index: BlockIndex, queries: DataFrame, k: int, every: bool = False, opened: list | None = None) -> DataFrame:
    """``query, id, score, rank`` of the ``k`` best chunks of each query by BM25, exactly.

    ``queries``: ``query, term``, a row for each word (repeats and nulls are ignored). Chunks match that hold any of a
    query's words, or all of them (``every``). Ties go to the smaller id. A query without a known word (with ``every``: with
    an unknown one) has no rows. ``opened`` gets the two tables of opened buckets, for measurements.
    """
    asked = queries.select("query", "term").where("query IS NOT NULL AND term IS NOT NULL").distinct()
    facts = index.stats.select(F.col("n").alias("rows"), F.coalesce("avgdl", F.lit(1.0)).alias("mean"))
    size = asked.groupBy("query").agg(F.count("*").cast("long").alias("terms"))
    terms = asked.join(index.dictionary.select("term", "docs"), "term").join(size, "query").crossJoin(F.broadcast(facts))  # one row
    terms = stored(terms.select("query", "term", idf(F.col("docs"), F.col("rows")).alias("idf"), "mean", "terms"), "batch-terms")
    heads = index.blocks.select("term", "bucket", "n", "impact", "avgdl").join(terms.select("term").distinct(), "term", "left_semi")
    met = salted_join(stored(heads, "batch-heads"), terms, "term", most=4096, name="batch")
    bounds = met.groupBy("query", "bucket").agg(F.sum(F.col("idf") * _head(F.col("mean"))).alias("bound"), F.max(F.col("idf") * _sure(F.col("mean"))).alias("sure"), F.max("n").alias("n"), F.count("*").alias("held"), F.first("terms").alias("terms"))
    bounds = stored(index.certain(bounds.where(F.col("held") == F.col("terms")) if every else bounds).select("query", "bucket", "bound", "sure", "n", "terms"), "batch-bounds")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "bucket")
    front = bounds.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= FIRST)  # cut before it is moved
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = stored(front.withColumn("_before", before).where(F.col("_before") < 4 * k).select("query", "bucket"), "batch-first")
    found = stored(_open(first, index, terms, every), "batch-found")
    least = _best(found, k).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    if not every:  # a chunk that holds one of the words well needn't hold the others
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sure"), "bucket"))
        reached = bounds.withColumn("_at", place).where(F.col("_at") <= k).where(F.col("_at") == k).select("query", F.col("sure").alias("least"))
        least = least.unionByName(reached).groupBy("query").agg(F.max("least").alias("least"))
    rest = bounds.join(first, ["query", "bucket"], "left_anti").join(least, "query", "left")
    rest = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _margin(F.col("terms")))).select("query", "bucket")
    if opened is not None:
        opened += [first, rest]
    return _best(found.unionByName(_open(rest, index, terms, every)), k)


def plain_words(query: str) -> tuple[list[str], bool] | None:
    """The words of a query that is one word, or words joined by OR alone or AND alone, over all columns, and whether all
    must be held; None for other queries."""
    tree = parse(query)

    def word(node: Node) -> str | None:
        if node.op != "phrase" or len(node.phrases) != 1:
            return None
        p = node.phrases[0]
        return p.words[0] if len(p.words) == 1 and not p.prefix and not p.initial and set(p.columns) == set(COLUMNS) else None

    def flat(node: Node, op: str) -> list[Node]:
        return [x for p in node.parts for x in flat(p, op)] if node.op == op else [node]

    op = tree.op if tree.op in ("and", "or") else "or"
    words = [word(n) for n in flat(tree, op)]
    return None if not words or None in words or len(set(words)) < len(words) else (words, op == "and")


def top_query(index: BlockIndex, words: list[str], k: int, every: bool = False, opened: list | None = None) -> DataFrame:
    """``id, score, rank`` of the ``k`` best chunks for a few words: ``top_batch`` with what it needs as literals, so that what
    bounds a block on its own is a filter on its term and impact and reaches the scan. The driver gets a row per word, the
    first buckets and the threshold."""
    spark = index.blocks.sparkSession
    every = every and len(words) > 1
    facts = index.stats.first()
    held = {r.term: r for r in index.dictionary.where(F.col("term").isin(words)).collect()}
    if not held or every and len(held) < len(words):
        return spark.createDataFrame([], "id long, score double, rank long")
    mean = float(facts.avgdl or 1.0)
    weights = spark.range(1).select(*[idf(F.lit(r.docs), F.lit(facts.n)) for r in held.values()]).first()
    weights = dict(zip(held, weights))
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("term")]
    blocks = index.blocks.where(F.col("term").isin(list(held)))
    bounds = blocks.groupBy("bucket").agg(F.sum(weight * _head(F.lit(mean))).alias("bound"), F.max(weight * _sure(F.lit(mean))).alias("sure"), F.max("n").alias("n"), F.count("*").alias("held"))
    bounds = index.certain(bounds.where(F.col("held") == len(words)) if every else bounds)
    front, total = [], 0
    for r in bounds.orderBy(F.desc("bound"), "bucket").limit(FIRST).collect():
        if total >= 4 * k:
            break
        front.append(r.bucket)
        total += r.n
    order = [F.desc("score"), F.asc("id")]

    def score(rows: DataFrame) -> DataFrame:
        each = rows.select("term", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        out = each.groupBy(F.col("p.ids").alias("id")).agg(_total(weight * impact(F.col("p.tfs"), F.col("p.dls"), F.lit(mean))), F.count("*").alias("held"))
        out = index.alive((out.where(F.col("held") == len(words)) if every else out).select("id", "score"))
        return out.orderBy(*order).limit(k)

    best = score(blocks.where(F.col("bucket").isin(front))).collect()
    least = best[-1].score - _margin(len(held)) if len(best) == k else float("-inf")
    if not every:  # a chunk that holds one of the words well needn't hold the others
        reached = bounds.select("sure").orderBy(F.desc("sure")).limit(k).agg(F.min("sure").alias("m"), F.count("*").alias("n")).first()
        least = max(least, reached.m - _margin(len(held))) if reached.n == k else least
    rows = blocks
    if least > float("-inf"):
        growth = {w: max(1.0, mean / r.low) for w, r in held.items()}
        peaks = {w: weights[w] * r.peak * growth[w] for w, r in held.items()}
        # a block of a word can matter only if with the others' best it reaches the threshold
        alone = [(F.col("term") == w) & (F.col("impact") >= (least - sum(peaks.values()) + peaks[w]) / (weights[w] * growth[w])) for w in held]
        rows = blocks.where(reduce(lambda a, b: a | b, alone))
        if len(held) > 1:
            rows = rows.join(bounds.where(F.col("bound") >= least).select("bucket"), "bucket", "left_semi")
    if opened is not None:
        opened.append(rows.select("term", "bucket"))
    return score(rows).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # k rows
