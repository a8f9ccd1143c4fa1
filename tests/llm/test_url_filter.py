from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivault.llm import url_filter as U
from tests.oracle import compare


def test_oracle(spark):
    n, m, different = compare(spark, U.op9_url_filter, U.ORACLE, "/root/testdata/sf0.01")
    assert n == m > 0 and not different


URLS = [
    (1, "http://WWW.Example.com/en/x?y#z"), (2, "http://example.com/en"), (3, "http://a.b.example.com/en/"), (4, "https://notexample.com/en/q"), (5, "http://x.net/es/1"), (6, "http://net/es/1"),
    (7, None), (8, ""), (9, "no scheme/en/"), (10, "http://"), (11, "http://host?q=/es/"), (12, "http://host#frag"), (13, "x://y://z/p"), (14, "http://ÄB.org/É"), (15, "http://bad.org/a/b/c"),
    (16, "http://sub.bad.org/"), (17, "http://good.org/list/x"), (18, "http://good.org/listed"), (19, "http://good.org/list"), (20, "http://a.com\n/x"), (21, "http://u:p@BAD.org.:8080/a"), (22, "http://good.org:80/%6Cist/%7e"), (23, "http://good.org/one%2fpage"), (24, "http://good.org/one%2Fpage/x"), (25, "http://good.org/100%"), (None, "http://bad.org/"), (1, "http://WWW.Example.com/en/x?y#z"),
]
LISTED = ["bad.org/", "good.org/list/", "good.org/one%2Fpage", "good.org/100%", "", None, "bad.org/"]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = max(((len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    name = host.rsplit("@", 1)[-1].rsplit(":", 1)[0].rstrip(".")
    place = re.sub("%([0-9A-Fa-f]{2})", lambda m: c if (c := chr(int(m[1], 16))).isascii() and (c.isalnum() or c in "-._~") else m[0].upper(), path) or "/"
    hit = any((name == k.split("/")[0] or name.endswith("." + k.split("/")[0])) and (place.startswith("/" + k.split("/", 1)[1]) if k.endswith("/") else place == "/" + k.split("/", 1)[1]) for k in LISTED if k)
    return host, path, best and best[1], best[2] if best else "block" if hit else "allow"


@pytest.mark.parametrize("most", [U.MOST_BYTES, 0])
def test_edges(spark, most):
    urls = spark.createDataFrame([(*u, "x", "y", "z") for u in URLS], "page_id long, url string, host string, rule string, entry string")
    listed = spark.createDataFrame([(x, 1) for x in LISTED], "entry string, h int")
    rows = U.url_verdicts(urls, "page_id", "url", listed, most_bytes=most).collect()
    got = sorted((repr(r.page_id), r.host, r.path, repr(r.rule), r.verdict) for r in rows)
    assert got == sorted((repr(i), h, p, repr(r), v) for i, u in URLS for h, p, r, v in [expected(u)])
    assert U.url_verdicts(urls.limit(0), "page_id", "url", listed).collect() == []
    assert {r.verdict for r in U.url_verdicts(urls, "page_id", "url", listed.limit(0), rules=()).collect()} == {"allow"}


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    n = 20_000
    listed = spark.range(n).select(F.xxhash64(F.concat(F.lit("in"), F.col("id").cast("string"))).alias("h"))
    table = U.build_filter(listed, -(-n * U.BITS_PER_ENTRY // 256))
    inside = listed.toPandas()["h"].to_numpy(np.int64)
    outside = spark.range(n).select(F.xxhash64(F.concat(F.lit("out"), F.col("id").cast("string"))).alias("h")).toPandas()["h"].to_numpy(np.int64)
    assert U.may_contain(table, inside).all()
    assert U.may_contain(table, outside).mean() < 0.02


def test_listing_fills_many_blocks_and_is_found(spark):
    entries = U.listing(spark)
    n = entries.count()
    assert n == 18 * (U.NUMBERED + 1) > 100_000 and -(-n * U.BITS_PER_ENTRY // 256) > 5000
    urls = spark.createDataFrame([(1, "http://spam-farm6999.example.org/x"), (2, "http://a.spam-farm.example.net/"), (3, "http://spam-farm7000.example.org/x"), (4, "http://spam-farm07.example.org/"), (5, "http://xspam-farm7.example.org/")], "page_id long, url string")
    for most in (U.MOST_BYTES, 0):
        assert [r.verdict for r in U.url_verdicts(urls, "page_id", "url", entries, most_bytes=most).orderBy("page_id").collect()] == ["block", "block", "allow", "allow", "allow"]


def test_long_urls_ask_for_few_keys(spark):
    """Keys are those of the listing's shapes only, however many slashes and dots a URL has."""
    deep = "http://" + "a." * 500 + "bad.org" + "/x" * 20_000
    urls = spark.createDataFrame([(k, deep) for k in range(20)], "page_id long, url string")
    listed = spark.createDataFrame([("bad.org/x/x/",), ("other.org/y",)], "entry string")
    assert {r.verdict for r in U.url_verdicts(urls, "page_id", "url", listed).collect()} == {"block"}
    keys = urls.limit(1).select(U.lookup_keys(U.host_of(F.col("url")), U.path_of(F.col("url")), [(2, 0), (2, 3)]).alias("k")).first().k
    assert len(keys) == 2 and "bad.org/x/x/" in keys
