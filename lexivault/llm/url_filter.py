"""URL filtering: host and path rules, then a listing of canonical URLs behind a blocked Bloom filter.

The listing is turned into 64-bit hashes of its canonical entries. Each hash picks one block of 256 bits and one bit in
each of the block's eight 32-bit words (a split-block Bloom filter), so a look-up touches one cache line. Every URL, in
canonical form, asks for the keys that could list it: its host and parent domains with its whole path or a directory above
it, of only those numbers of labels and slashes that the listing's entries have. Keys that the filter passes are possible
hits; only they go to an exact hash join with the listing, which removes the false positives. The filter's size follows the
listing. Up to ``most_bytes`` it is collected and broadcast; beyond that it stays in pieces by hash, and the distinct
hashes that are asked for go to their pieces. Either way gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from ._shared import stored

#: The contract's rules: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: What the query's listing is made of: sites of unwanted kinds, plain and numbered, under each of three domains.
KINDS, NUMBERED, DOMAINS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"), 7000, ("com", "net", "org")

#: Odd multipliers that pick a bit in each word of a block; those of the split-block filter of the Parquet format.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
BITS_PER_ENTRY = 12
MOST_BYTES = 64 << 20
#: Hashes of a piece of a filter that isn't broadcast, listed or asked.
PIECE = 4_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path together) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def canonical_host(host: Column) -> Column:
    """Without user info, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)\A.*@", ""), r":[0-9]*\z", ""), r"\.+\z", "")


#: Percent escapes of characters that never need one: letters, digits and these.
_PLAIN = tuple((f"%{ord(c):02X}", c) for c in (*(chr(k) for k in range(128) if chr(k).isalnum()), "-", ".", "_", "~"))


def canonical_path(path: Column) -> Column:
    """``/`` if empty, and with escapes of plain characters undone and the others in upper case."""

    def undo() -> Column:
        parts = F.split(path, "%")
        fixed = F.transform(parts, lambda p, k: F.when((k > 0) & p.rlike("(?s)^[0-9A-Fa-f]{2}"), _escape(F.upper(F.substring(p, 1, 2)), F.substring(p, 3, 1 << 30))).otherwise(F.when(k > 0, F.concat(F.lit("%"), p)).otherwise(p)))
        return F.array_join(fixed, "")

    return F.when(path == "", F.lit("/")).when(F.contains(path, F.lit("%")), undo()).otherwise(path)


def _escape(code: Column, rest: Column) -> Column:
    plain = F.create_map(*[F.lit(v) for e, c in _PLAIN for v in (e[1:], c)])
    return F.concat(F.coalesce(plain[code], F.concat(F.lit("%"), code)), rest)


def shape(entry: Column) -> Column:
    """Labels of a canonical entry's host, and slashes of its path if this is a directory, else 0."""
    host = F.substring_index(entry, "/", 1)
    path = F.expr("substr(entry, length(substring_index(entry, '/', 1)) + 1)")
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.struct((F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1).alias("labels"), F.when(F.endswith(entry, F.lit("/")), slashes).otherwise(0).alias("slashes"))


def lookup_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """Array of the canonical keys that would list a URL of canonical ``host`` and ``path``, one of each of ``shapes`` that
    it has: the host's last labels with the path up to a slash, or with the whole path."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    wanted = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("slashes")) for a, b in shapes])
    having = F.filter(wanted, lambda w: (w.labels <= labels) & (w.slashes <= slashes))
    domain = lambda w: F.call_function("substring_index", host, F.lit("."), -w.labels)
    place = lambda w: F.when(w.slashes > 0, F.concat(F.call_function("substring_index", path, F.lit("/"), w.slashes), F.lit("/"))).otherwise(path)
    return F.array_distinct(F.transform(having, lambda w: F.concat(domain(w), place(w))))


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and the eight bit masks of each 64-bit hash."""
    h = hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        shift = (h.astype(np.uint32)[:, None] * np.array(SALTS, dtype=np.uint32)) >> np.uint32(27)
    return block.astype(np.int64), np.uint32(1) << shift


def build_filter(listed: DataFrame, blocks: int) -> np.ndarray:
    """The filter of ``listed`` (one long column ``h``): ``blocks`` rows of eight 32-bit words, made on the executors
    as one row per block and partition, OR-ed by block, and collected; its size is ``32 * blocks`` bytes."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, masks = _bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), blocks)
            if len(block):
                order = np.argsort(block, kind="stable")
                found, first = np.unique(block[order], return_index=True)
                words = np.bitwise_or.reduceat(masks[order], first, axis=0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(8)]], names=["block", *[f"w{k}" for k in range(8)]])

    words = [f"w{k}" for k in range(8)]
    rows = listed.select("h").mapInArrow(fill, "block long, " + ", ".join(f"{w} long" for w in words)).groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words])
    table = np.zeros((blocks, 8), dtype=np.uint32)
    got = rows.toPandas()
    if len(got):
        table[got["block"].to_numpy()] = got[words].to_numpy().astype(np.uint32)
    return table


def may_contain(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, masks = _bits(hashes, len(table))
    return ((table[block] & masks) == masks).all(axis=1)


def _passing_by_piece(asked: DataFrame, entries: DataFrame, listed: int) -> DataFrame:
    """The distinct hashes ``h`` of ``asked`` that the filter of ``entries`` passes, a piece of the filter in each task."""
    questions = asked.agg(F.approx_count_distinct("h").alias("n")).first().n
    pieces = max(1, -(-max(listed, questions) // PIECE))
    piece = F.pmod("h", F.lit(pieces)).alias("piece")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        inside, wanted = (t.column("h").to_numpy().astype(np.int64) for t in (right, left))
        if not len(inside) or not len(wanted):
            return left.select(["h"]).slice(0, 0)
        table = np.zeros((max(1, -(-len(inside) * BITS_PER_ENTRY // 256)), 8), dtype=np.uint32)
        block, masks = _bits(inside, len(table))
        for k in range(8):
            np.bitwise_or.at(table[:, k], block, masks[:, k])
        return left.select(["h"]).filter(pa.array(may_contain(table, wanted)))

    left, right = (t.select("h").distinct().select("h", piece).groupBy("piece") for t in (asked, entries))
    return left.cogroup(right).applyInArrow(probe, "h long")


def url_verdicts(urls: DataFrame, id_col: str, url_col: str, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``<id_col>, host, path, rule, verdict, listed`` for every row of ``urls``.

    ``listed``: canonical entries, string column ``entry``: ``host/path``, the host in lower case without port; an entry
    that ends with ``/`` lists the directory and all below, any other the one path; both for the host and its
    subdomains. ``verdict`` is the longest rule's, else ``block`` if the listing has one of the URL's keys, else
    ``allow``. ``host`` and ``path`` stand as in the URL; the look-up takes their canonical forms. ``listed`` is null where a
    rule speaks, as the listing isn't asked then.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed. Repeated rows, null ids
    and extra columns of any name stay rows of their own; empty tables give no rows; an empty or null listing entry
    is ignored.
    """
    spark = ship(urls.sparkSession)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    parsed = urls.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parsed = stored(parsed.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("_row", F.monotonically_increasing_id()), "url-parsed")
    entries = stored(listed.select("entry").where("entry is not null and contains(entry, '/')").distinct().withColumn("h", F.xxhash64("entry")), "url-listing")
    n = entries.count()
    # a handful of different shapes, however long the listing
    shapes = sorted((r.shape.labels, r.shape.slashes) for r in entries.select(shape(F.col("entry")).alias("shape")).distinct().collect())
    if not shapes:
        return parsed.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.lit(False)).alias("listed"))
    blocks = max(1, -(-n * BITS_PER_ENTRY // 256))
    keys = lookup_keys(canonical_host(F.col("host")), canonical_path(F.col("path")), shapes)
    asked = parsed.where("rule is null and host <> ''").select("_row", F.explode(keys).alias("entry")).withColumn("h", F.xxhash64("entry"))
    if 32 * blocks <= most_bytes:
        table = spark.sparkContext.broadcast(build_filter(entries, blocks).tobytes())

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.frombuffer(table.value, dtype=np.uint32).reshape(-1, 8)
            for batch in batches:
                keep = may_contain(words, batch.column("h").to_numpy(zero_copy_only=False).astype(np.int64))
                if keep.any():
                    yield batch.filter(pa.array(keep))

        asked = asked.select("_row", "h", "entry").mapInArrow(passing, T.StructType([T.StructField("_row", T.LongType()), T.StructField("h", T.LongType()), T.StructField("entry", T.StringType())]))
    else:
        asked = asked.join(stored(_passing_by_piece(asked, entries, n), "url-passing"), "h", "left_semi")
    # a listed host may hold a third of the crawl: the larger side is not shuffled where the listing is small enough
    # for Spark to broadcast by its size, and hot keys are split by adaptive execution where it is not
    hits = asked.join(entries.select("entry"), "entry", "left_semi").select("_row").distinct().withColumn("_hit", F.lit(True))
    out = parsed.join(hits, "_row", "left")
    by_list = F.coalesce("_hit", F.lit(False))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(by_list, "block").otherwise("allow")).alias("verdict"), F.when(F.col("rule").isNull(), by_list).alias("listed"))


def listing(spark, numbered: int = NUMBERED) -> DataFrame:
    """The query's listing: every kind of ``KINDS``, plain and with each number below ``numbered``, in all ``DOMAINS``."""
    numbers = spark.range(-1, numbered).select(F.when(F.col("id") < 0, "").otherwise(F.col("id").cast("string")).alias("number"))
    kinds, domains = (F.explode(F.array(*[F.lit(v) for v in values])) for values in (KINDS, DOMAINS))
    return numbers.withColumn("kind", kinds).withColumn("domain", domains).select(F.concat("kind", "number", F.lit(".example."), "domain", F.lit("/")).alias("entry"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", listing(spark))


def _oracle() -> str:
    fits = "\n".join(f"    WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN '{h + p}'" for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)))
    says = "\n".join(f"    WHEN rule = '{h + p}' THEN '{v}'" for v, h, p in RULES)
    listed = "(?:^|\\.)(?:" + "|".join(KINDS) + ")(|0|[1-9][0-9]{0,3})\\.example\\.(?:" + "|".join(DOMAINS) + ")$"
    canonical = "regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '')"
    return f"""
WITH split AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)\\A.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)\\A.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
  SELECT *, CASE
{fits}
    END AS rule FROM split),
asked AS (
  SELECT *, regexp_matches(name, '{listed}') AND coalesce(try_cast(nullif(regexp_extract(name, '{listed}', 1), '') AS INT), 0) < {NUMBERED} AS hit
  FROM (SELECT *, {canonical} AS name FROM ruled))
SELECT page_id, host, path, rule, CASE
{says}
    WHEN hit THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN hit END AS listed
FROM asked
"""


ORACLE = _oracle()
