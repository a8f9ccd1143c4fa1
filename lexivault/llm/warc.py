"""Content-addressed WARC archives.

``write_warc`` writes pages as WARC/1.1 records, in segments of some megabytes that each are the bytes of a WARC file;
``read_warc`` parses them back. ``write_archive`` takes records apart: ``payloads`` stores the bytes of each distinct payload
once, under the SHA-256 that is verified on the way, and ``headers`` keeps each record's exact header bytes with the digest
that they name. ``read_archive`` joins the two, checks length and digest, and gives the original records back byte for byte
(``serialize``). Hashes, joins and headers are DataFrame functions; making and parsing segments is Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from ._shared import stored

#: Payloads below so many bytes are never revisits: a pointer would save nothing.
LEAST_BYTES = 100
#: Groups that a digest's records are dealt to, so that one payload held by a third of all records is no one task's.
SALT = 16
#: Bytes of records in a segment, before the last of it.
SEGMENT_BYTES = 4 << 20
#: Records of one digest that a task reconstructs together.
HOT = 4096
EPOCH = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _hashed(pages: DataFrame, body_col: str) -> DataFrame:
    """``pages`` with the payload's bytes, length and digest."""
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    return pages.withColumn("_payload", body).withColumn("_digest", F.sha2("_payload", 256)).withColumn("_bytes", F.octet_length("_payload").cast("long"))


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """One record per row: ``header, block``, a revisit's block being empty.

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest id are responses and the others
    revisits of it; shorter payloads are all responses. A null body is an empty payload, a null URL an empty target.
    A null id sorts last and never is referred to: rows with null ids whose payload no other id has are responses. Rows
    that repeat the smallest id are responses all. Columns other than the three named are ignored. No rows, no records.
    """
    named = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.col(body_col).alias("body"))
    made = _hashed(named, "body").select("page_id", "url", F.col("_payload").alias("payload"), F.col("_digest").alias("payload_digest"), F.col("_bytes").alias("payload_bytes"), F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int").alias("salt"))
    # only the digests of several records are joined, so payloads move where these are too many to be broadcast
    firsts = made.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = stored(firsts.select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")), "warc-firsts")
    typed = made.join(firsts, ["payload_digest", "salt"], "left")
    revisit = F.coalesce(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))), F.lit(False))
    typed = typed.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", name(F.col("page_id"))),
        _line("WARC-Date", F.lit(EPOCH)),
        # a line break in a URL would end the header
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", name(F.col("first"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return typed.select(F.encode(header, "UTF-8").alias("header"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("block"))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes ``records`` (``header, block``) under ``path`` as a table of ``segment``: each the bytes of a WARC file."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for header, block in zip(batch.column(0), batch.column(1)):
                held += (header.as_py(), block.as_py(), b"\r\n\r\n")
                size += len(held[-3]) + len(held[-2]) + 4
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["segment"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["segment"])

    records.select("header", "block").mapInArrow(run, "segment binary").write.option("compression", "zstd").parquet(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``header, block`` of every record in the segments under ``path``; a damaged segment fails the read."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in batch.column(0):
                found = list(parse(segment.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["header", "block"])

    return spark.read.schema("segment binary").parquet(path).mapInArrow(run, "header binary, block binary")


def write_archive(records: DataFrame, path: str) -> None:
    """Writes the archive of ``records`` (``header, block``) under ``path``: ``headers``, a row per record, and ``payloads``, a
    row per digest. A block that isn't what its header names isn't stored, so its record will be found invalid. Which of
    equal payloads is kept is of no account. Long payloads stand in one response as a rule, and only those that
    don't are moved to find equal ones."""
    records.select("header").write.parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    named = records.select(_named_digest(text).alias("payload_digest"), field(text, "WARC-Type").alias("type"), F.col("block").alias("payload"))
    sound = named.where((F.col("type") != "revisit") & (F.sha2("payload", 256) == F.col("payload_digest"))).select("payload_digest", "payload")
    short = F.octet_length("payload") < LEAST_BYTES
    again = stored(sound.where(~short).groupBy("payload_digest").agg(F.count("*").alias("n")).where("n > 1").select("payload_digest"), "warc-again")
    long = sound.where(~short)
    repeated = sound.where(short).union(long.join(again, "payload_digest", "left_semi")).dropDuplicates(["payload_digest"])
    long.join(again, "payload_digest", "left_anti").union(repeated).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _named_digest(header: Column) -> Column:
    return F.regexp_replace(field(header, "WARC-Payload-Digest"), "^sha256:", "")


def field(header: Column, name: str) -> Column:
    """The value of a header line, null if the header hasn't got it."""
    found = F.regexp_extract(header, rf"(?i)\r\n{re.escape(name)}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive with its payload joined by digest: ``header, record_id, record_type, refers_to,
    target_uri, payload_digest, payload_bytes, payload, valid``. Digest and length are those of the payload that was found;
    ``valid`` says that the header names them. A record whose payload is missing has null payload and is not valid."""
    heads = spark.read.schema("header binary").parquet(f"{path}/headers").withColumn("_h", F.decode("header", "UTF-8"))
    named = heads.select(
        "header",
        field(F.col("_h"), "WARC-Record-ID").alias("record_id"),
        field(F.col("_h"), "WARC-Type").alias("record_type"),
        field(F.col("_h"), "WARC-Refers-To").alias("refers_to"),
        field(F.col("_h"), "WARC-Target-URI").alias("target_uri"),
        _named_digest(F.col("_h")).alias("named"),
        field(F.col("_h"), "WARC-Payload-Length").cast("long").alias("named_bytes"),
    )
    # a payload of very many records is given to several tasks
    parts = stored(named.groupBy("named").agg(F.ceil(F.count("*") / F.lit(HOT)).cast("int").alias("parts")).where("parts > 1"), "warc-hot")
    part = F.pmod(F.xxhash64("record_id"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = named.join(parts, "named", "left").withColumn("part", part).drop("parts")
    store = spark.read.schema("payload_digest string, payload binary").parquet(f"{path}/payloads").withColumnRenamed("payload_digest", "named")
    store = store.join(parts, "named", "left").select("named", "payload", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    found = dealt.join(store, ["named", "part"], "left").withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    valid = F.coalesce((F.col("payload_digest") == F.col("named")) & (F.col("payload_bytes") == F.col("named_bytes")), F.lit(False))
    return found.select("header", "record_id", "record_type", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload", valid.alias("valid"))


def serialize(records: DataFrame) -> DataFrame:
    """Adds ``warc``: the record as it stands in a WARC file, header, block and the two line ends after it. A revisit's
    block is empty."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.withColumn("warc", F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")))


def parse(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header bytes and block of each record in the bytes of an uncompressed WARC file; ValueError where it breaks off."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record header at byte {at}")
        header = data[at : end + 4]
        length = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)", header)
        if length is None:
            raise ValueError(f"no Content-Length in the record at byte {at}")
        stop = end + 4 + int(length[1])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield header, data[end + 4 : stop]
        at = stop + 4


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Writes ``pages`` as WARC segments to the shared folder, reads these, archives their records by content, and tells
    what the reconstructed records hold."""
    import uuid

    from ..runtime import shared_dir

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(to_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), f"{path}/segments")
    write_archive(read_warc(spark, f"{path}/segments"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(F.col(c)) != "", number(F.col(c)).cast("long"))
    return read_archive(spark, path).select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"), "valid")


ORACLE = f"""
WITH made AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM made),
firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id > f THEN f END AS refers_to, true AS valid
FROM firsts
"""
