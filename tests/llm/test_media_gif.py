from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexivault.llm import media_gif as G


def slow_decode(stream: bytes, size: int, most: int) -> bytes:
    """The textbook decoder, a code at a time."""
    clear, out, bits, have, at = 1 << size, bytearray(), 0, 0, 0
    table, width, before = {}, size + 1, None
    while len(out) < most:
        while have < width:
            if at == len(stream):
                return bytes(out)
            bits |= stream[at] << have
            have, at = have + 8, at + 1
        code, bits, have = bits & ((1 << width) - 1), bits >> width, have - width
        if code == clear:
            table, width, before = {k: bytes([k]) for k in range(clear)}, size + 1, None
            nxt = clear + 2
            continue
        if code == clear + 1:
            break
        entry = table[code] if code in table else before + before[:1]
        out += entry
        if before is not None and nxt < 4096:
            table[nxt] = before + entry[:1]
            nxt += 1
            if nxt == 1 << width and width < 12:
                width += 1
        before = entry
    return bytes(out[:most])


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000) | st.binary(min_size=1, max_size=4).map(lambda b: b * 4000))
def test_codec_round_trip(data):
    stream = G.lzw_encode(data)
    assert slow_decode(stream, 8, len(data)) == data
    assert G.lzw_decode(stream, 8, len(data)).tobytes() == data


def test_many_clears():
    data = np.random.default_rng(3).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert G.lzw_decode(G.lzw_encode(data), 8, len(data)).tobytes() == data


def small_gif(frames, loop=b"", width=2, height=2):
    """A GIF with a four-colour palette; each frame is (left, top, w, h, samples, disposal, transparent, delay)."""
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + palette + loop
    for left, top, w, h, samples, disposal, transparent, delay in frames:
        flags = disposal << 2 | (transparent is not None)
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, delay, transparent or 0, 0)
        codes = [4] + [c for s in samples for c in (s, 4)][:-1] + [5]  # a clear after each sample keeps codes at three bits
        bits = sum(c << (3 * k) for k, c in enumerate(codes))
        stream = bits.to_bytes((3 * len(codes) + 7) // 8, "little")
        out += struct.pack("<BHHHHBB", 0x2C, left, top, w, h, 0, 2) + bytes([len(stream)]) + stream + b"\0"
    return out + b";"


def test_disposal_and_transparency():
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    gif = small_gif([(0, 0, 2, 2, [0, 0, 0, 0], 1, None, 5), (0, 0, 2, 1, [1, 3], 2, 3, 7), (1, 1, 1, 1, [2], 3, None, 9), (0, 1, 1, 1, [1], 0, None, 0)])
    a, b, c, d = G.decode_gif(gif)
    assert a.canvas.tolist() == [[red, red], [red, red]] and a.delay_ms == 50
    assert b.canvas.tolist() == [[green, red], [red, red]]  # a transparent sample leaves what is below
    assert c.canvas.tolist() == [[[0] * 4, [0] * 4], [red, blue]]  # the second frame's place was cleared
    assert d.canvas.tolist() == [[[0] * 4, [0] * 4], [green, red]]  # the third frame was taken back
    assert G.histogram(a.canvas)[7] == 4


def test_malformed():
    good = G.encode_gif(b"x" * 192)
    for bad in (b"", b"nope", good[:20], good[:-30], good.replace(b"\x2c", b"\x77", 1)):
        try:
            list(G.decode_gif(bad))
        except ValueError:
            pass


@pytest.mark.parametrize("n", [192, 192 * 3, 192 * (G.ROWS + 5)])
def test_payload_round_trip(n):
    for data in (bytes(k % 256 for k in range(n)), b"\0" * n, np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()):
        payload, frames = G.payload_of(G.encode_gif(data))
        assert payload == data and len(frames) == -(-n // (192 * G.ROWS))
        assert frames[0][8][:8] == np.bincount(np.frombuffer(data[: 192 * G.ROWS], np.uint8) >> 5, minlength=8).tolist()
        assert [f[:2] for f in frames] == [(k, 10 * G.DELAY_CS) for k in range(len(frames))]


def test_query_against_texts(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = G.op2_media_gif(spark, str(tmp_path)).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").encode()) for r in docs.collect())
    assert len(rows) == len(want)
    by_hash = {}
    for _, _, text in want:
        payload = text + b" " * (-len(text) % 192 if text else 192)
        by_hash[hashlib.sha256(payload).hexdigest()] = (len(text), len(payload), zlib.crc32(payload[-16:]))
    seen = {}
    for r in rows:
        assert by_hash[r.payload_sha256] == (r.n_bytes, r.payload_bytes, r.tail_crc32)
        assert seen.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert G.store_as_gif(docs.limit(0), "doc_id", "text").collect() == []


def test_frames_table(spark):
    gif = small_gif([(0, 0, 2, 2, [0, 1, 2, 3], 1, None, 5), (0, 0, 1, 1, [1], 1, None, 6)])
    media = spark.createDataFrame([(1, gif, "e"), (2, None, "f"), (3, b"junk", None), (None, gif, "g")], "id long, gif binary, error string")
    rows = G.gif_frames(media, "id", "gif").collect()
    assert [r.delay_ms for r in rows if r.id == 1] == [50, 60]
    assert [r.error for r in rows if r.id in (2, 3)] == ["null", "not a GIF"]
    assert sum(r.id is None for r in rows) == 2
    assert len(rows[0].histogram) == 20 and len(rows[0].rgba) == 16


def test_query_on_the_whole_table(spark):
    """Digests and features of all texts, from the texts alone."""
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = G.op2_media_gif(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        payload = text + b" " * (-len(text) % 192 if text else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        if len(payload) <= 192 * G.ROWS:
            x = np.frombuffer(payload, np.uint8)
            levels = [",".join(map(str, np.bincount(v, minlength=n))) for v, n in ((x >> 5, 8), (x >> 2 & 7, 8), (x & 3, 4))]
            assert r.feature == "|".join(["1", str(10 * G.DELAY_CS), *levels])
