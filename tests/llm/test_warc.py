from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lexivault.llm import warc as W
from tests.oracle import compare


def test_oracle(spark):
    n, m, different = compare(spark, W.op7_warc, W.ORACLE, "/root/testdata/sf0.01")
    assert n == m > 0 and not different


@pytest.fixture()
def pages(spark):
    long = "é" * 60
    rows = [(5, "http://a/", long), (3, "http://b/\r\nX-Bad: 1", long), (9, None, long), (None, "http://c/", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1 not a record" * 9), (8, "u", "z" * 200_000), (8, "u", "z" * 200_000)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, header string, payload string")


def test_edges(spark, pages, tmp_path):
    pages.select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    rows = W.op7_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 11 and all(r.valid for r in rows)
    by = {r.page_id: r for r in rows}
    assert (by[3].record_type, by[5].record_type, by[9].refers_to, by[None].refers_to) == ("response", "revisit", 3, 3)
    assert by[1].record_type == by[2].record_type == "response"
    assert by[4].payload_bytes == 0 and by[4].payload_digest == hashlib.sha256(b"").hexdigest()
    assert [r.record_type for r in rows if r.page_id == 8] == ["response"] * 2
    W.write_warc(W.to_records(pages.limit(0)), f"{tmp_path}/none/segments")
    W.write_archive(W.read_warc(spark, f"{tmp_path}/none/segments"), f"{tmp_path}/none")
    assert W.read_archive(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("segment", [W.SEGMENT_BYTES, 300])
def test_payloads_are_stored_once_and_records_come_back_whole(spark, pages, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(W, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(W, "HOT", 2)
    W.write_warc(W.to_records(pages), f"{tmp_path}/segments")
    written = b"".join(bytes(r.segment) for r in spark.read.parquet(f"{tmp_path}/segments").collect())
    assert spark.read.parquet(f"{tmp_path}/segments").count() >= (1 if segment > 300 else 5)
    W.write_archive(W.read_warc(spark, f"{tmp_path}/segments"), f"{tmp_path}/a")
    stored = spark.read.parquet(f"{tmp_path}/a/payloads")
    assert stored.count() == pages.select(F.coalesce("html", F.lit(""))).distinct().count()
    rows = W.serialize(W.read_archive(spark, f"{tmp_path}/a")).collect()
    # the records that were written, byte for byte
    assert sorted(bytes(r.warc) for r in rows) == sorted(h + b + b"\r\n\r\n" for h, b in W.parse(written)) and len(rows) == 11
    for r in rows:
        assert r.valid and hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest
    lines = [line for r in rows for line in bytes(r.header).split(b"\r\n")]
    assert not any(line.startswith(b"X-Bad") for line in lines)


def test_damage_is_seen(spark, pages, tmp_path):
    W.write_archive(W.to_records(pages), f"{tmp_path}/a")
    bad = spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.when(F.octet_length("payload") == 5, F.lit(b"other")).otherwise(F.col("payload")))
    bad.where(F.octet_length("payload") != 120).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    rows = W.read_archive(spark, f"{tmp_path}/b").collect()
    assert sum(not r.valid for r in rows) == 2 + 4 and sum(r.payload is None for r in rows) == 4
    # a block that isn't what its header names is not taken into an archive
    false = W.to_records(pages).withColumn("block", F.when(F.octet_length("block") == 5, F.lit(b"other")).otherwise(F.col("block")))
    W.write_archive(false, f"{tmp_path}/c")
    assert sum(not r.valid for r in W.read_archive(spark, f"{tmp_path}/c").collect()) == 2
    for broken in (b"junk", b"WARC/1.1\r\nA: b\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"):
        with pytest.raises(ValueError):
            list(W.parse(broken))
