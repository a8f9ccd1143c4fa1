"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Every source's documents are shuffled (by the MD5 of their key) into one stream of words, and the stream is cut into
blocks of ``block`` words. A source whose target is ``t`` words needs ``q`` slots, so the mix has ``Q = sum(q)`` slots.
Slot ``i`` carries the golden-ratio point ``i * g mod Q`` with ``g`` the integer nearest ``Q / golden ratio`` that is
coprime to ``Q``: the integer form of the Kronecker sequence, which visits each of the ``Q`` cells once. The point is
mapped through the cumulative slot counts to its source; slots are ranked within their source, and rank ``k`` takes
block ``k mod blocks`` of its source. The last slot of a source is cut to the exact target. Joining slots and blocks gives
the mix: for every slot the pieces of documents that its words come from.

Ranks and stream positions are running counts over very large groups, so they are computed in two levels: per bucket
(partial sums that Spark combines before shuffling) and within a bucket. No task holds a whole source.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

#: Weights of the sources in code-point order, repeating; a documented default of the contract.
WEIGHTS = (3.0, 1.0, 2.0)
BLOCK = 512
BUCKETS = 4096
#: Slots that are ranked in one group, and cells of the slot line that are joined in one group.
RUN = 65536


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs, without building an array of them."""
    lead = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]++", "")
    return F.length(F.regexp_replace(lead, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, weight, target`` for each source of ``sized`` (``source, size``), null being one.

    The sources share ``share`` times all words by weight, none above ``cap`` times its own size: the excess is reshared
    by weight among the others. With sources in order of ``cap * size / weight``, the level is the largest of
    ``(total - caps of the first k) / (weights of the rest)`` over all k, and a target is ``min(cap * size, level * weight)``.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = total.withColumn("pos", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = named.withColumn("weight", F.element_at(cycle, (F.col("pos") % len(weights) + 1).cast("int"))).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    upto = Window.orderBy((F.col("top") / F.col("weight")), "pos").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("top").over(upto), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    leveled = named.withColumn("at", level).withColumn("level", F.max("at").over(everyone))
    return leveled.select("source", "source_size", "pos", "weight", F.least("top", F.col("level") * F.col("weight")).alias("target"))


def _running(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before each row, by ``group`` in order of ``bucket``, ``order``."""
    per = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = per.select(*group, bucket, F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inside", inside).join(before, [*group, bucket]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def _step(q: int) -> int:
    g = max(1, round(q * 0.6180339887498949))
    while gcd(g, q) != 1:
        g += 1
    return g


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix's slots, in no order: ``slot, pos, rank, turn, block, words``.

    ``targets``: as of ``source_targets``, with ``source_size`` and ``target``. Slot numbers count from 0 and are
    the order of the mix; ``rank`` counts a source's slots, ``turn`` how often its stream went by before, ``block`` is the
    block of its stream and ``words`` the most that the slot takes of it (less than ``block`` only in a source's last slot).
    """
    spark = targets.sparkSession
    want = F.round("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    full = F.expr("wanted div size")
    rest = F.col("wanted") % F.col("size")
    quota = targets.withColumn("wanted", F.when(F.col("source_size") > 0, want).otherwise(0)).withColumn("size", size).withColumn("blocks", blocks)
    quota = quota.withColumn("quota", full * F.col("blocks") + F.ceil(rest / F.lit(block)).cast("long")).withColumn("tail", rest % F.lit(block))
    quota = quota.where("quota > 0").withColumn("high", F.sum("quota").over(Window.orderBy("pos"))).withColumn("low", F.col("high") - F.col("quota"))
    q = int(quota.agg(F.coalesce(F.max("high"), F.lit(0)).alias("q")).first().q)
    step = _step(q) if q else 1
    back = pow(step, -1, q) if q > 1 else 0
    cell = F.expr(f"point div {RUN}")
    # each point of the slot line finds its source among those that its cell of RUN points touches
    parts = max(1, min(-(-q // 1_000_000), 100_000))
    points = spark.range(0, q, 1, parts).toDF("point").withColumn("cell", cell)
    touched = quota.select("pos", "low", "high", "blocks", "quota", "tail", F.explode(F.sequence(F.expr(f"low div {RUN}"), F.expr(f"(high - 1) div {RUN}"))).alias("cell"))
    slots = points.join(touched, "cell").where("point >= low and point < high")
    wide = F.col("point").cast("decimal(19,0)") * F.lit(back).cast("decimal(19,0)")
    slots = slots.withColumn("slot", (wide % F.lit(max(q, 1)).cast("decimal(19,0)")).cast("long")).withColumn("run", F.expr(f"slot div {RUN}")).withColumn("one", F.lit(1).cast("long"))
    slots = _running(slots, ["pos"], "run", [F.col("slot")], "one", "rank")
    last = (F.col("rank") == F.col("quota") - 1) & (F.col("tail") > 0)
    return slots.select("slot", "pos", "rank", F.expr("rank div blocks").alias("turn"), (F.col("rank") % F.col("blocks")).alias("block"), F.when(last, F.col("tail")).otherwise(F.lit(block)).cast("long").alias("words"))


def _place(docs: DataFrame, share: float, cap: float, weights: tuple[float, ...], block: int, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The targets of the sources, every row's place in its source's shuffled stream (``row, pos, doc_id, source, size,
    text_hash, start``), and the mix's pieces."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(key).alias("shuffle"), F.xxhash64("text").alias("text_hash")), "mix-sizes")
    targets = stored(source_targets(sized, share, cap, weights), "mix-targets")
    named = sized.join(targets.select(F.col("source").alias("_source"), "pos"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    named = named.withColumn("bucket", (F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("int"))
    placed = _running(named, ["pos"], "bucket", [F.col("shuffle"), F.asc_nulls_first("doc_id"), F.col("size"), F.col("text_hash")], "size", "start")
    placed = stored(placed.withColumn("row", F.monotonically_increasing_id()), "mix-placed")
    parts = placed.where("size > 0").select("row", "pos", "start", (F.col("start") + F.col("size")).alias("end"), F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    lead = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    stop = F.least(F.col("end") - F.col("block") * block, F.lit(block), F.col("words"))
    pieces = parts.join(schedule(targets, block), ["pos", "block"]).where(stop > lead)
    pieces = pieces.select("slot", "turn", lead.alias("offset"), "row", (F.col("block") * block + lead - F.col("start")).alias("first_word"), (stop - lead).cast("long").alias("words"))
    return targets, placed, pieces


def mixed_pieces(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """The mix itself: ``slot, offset, doc_id, source, first_word, words``, a row for every piece of a document in a slot.
    In order of ``slot, offset`` the pieces are the mixed stream: ``words`` words of the document from its ``first_word``
    (counted from 0) on. Rows and nulls are treated as by ``mix``."""
    _, placed, pieces = _place(docs, share, cap, weights, block, buckets)
    return pieces.join(placed.select("row", "doc_id", "source"), "row").select("slot", "offset", "doc_id", "source", "first_word", "words")


def mixed_documents(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """Whole documents in the mix: each row of ``docs`` once for every time that slots take words of it, with all its columns,
    in runs that follow the slots which the copies begin in. Rows that are equal in doc_id, source and text go together."""
    _, placed, pieces = _place(docs, share, cap, weights, block, buckets)
    turns = pieces.groupBy("row", "turn").agg(F.min("slot").alias("slot"))
    copies = turns.join(placed.select("row", "doc_id", "source", "size", "text_hash"), "row").groupBy("doc_id", "source", "size", "text_hash", "turn").agg(F.min("slot").alias("slot"))
    names = ("doc_id", "source", "size", "text_hash")
    copies = stored(copies.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)], "slot"), "mix-copies")
    rows = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"))
    own = (F.col("row.doc_id"), F.col("row.source"), word_count(F.col("row.text")), F.xxhash64("row.text"))
    rows = rows.select("row", *[c.alias(f"r{k}") for k, c in enumerate(own)])
    same = F.col("r0").eqNullSafe(F.col("c0")) & F.col("r1").eqNullSafe(F.col("c1")) & (F.col("r2") == F.col("c2")) & (F.col("r3") == F.col("c3"))
    mixed = rows.join(copies, same).select("row", "slot").withColumn("run", F.expr(f"slot div {RUN // 16}"))
    return mixed.repartition("run").sortWithinPartitions("slot").select("row.*")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` for every row of ``docs`` (``doc_id, text, source``).

    ``taken`` is the number of the row's words in the mix, repeats counted: those of its pieces in the scheduled slots. A
    source takes its target exactly, rounded to a word.

    Null text counts 0 words, and a row of 0 words takes 0; null sources are one source, last in order; a null doc_id
    is shuffled as the text ``null``; repeated doc_ids are rows of their own (among rows of equal doc_id, the smaller
    goes first). Other columns of ``docs`` are ignored, whatever their names. No rows give no rows.
    """
    targets, placed, pieces = _place(docs, share, cap, weights, block, buckets)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    info = targets.select("pos", "source_size", "target")
    return placed.join(taken, "row", "left").join(info, "pos").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Sizes, targets and the shuffled streams in plain windows; each row's share of a stream's first ``target`` words, the
#: stream repeated, in closed form instead of slots and blocks.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS shuffle FROM documents),
total AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS pos, source_size * 2.0::DOUBLE AS top FROM total),
weighed AS (SELECT *, [3.0, 1.0, 2.0][(pos % 3 + 1)::INT]::DOUBLE AS weight FROM named),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lv
  FROM weighed WINDOW w AS (ORDER BY top / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(top, max(lv) OVER () * weight) AS target FROM levels),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY shuffle, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
want AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, p.source, p.start, greatest(t.source_size, 1) AS whole, round(t.target)::BIGINT AS wanted
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (wanted // whole) + greatest(least(size, wanted % whole - start), 0))::BIGINT AS taken, source
FROM want
"""
