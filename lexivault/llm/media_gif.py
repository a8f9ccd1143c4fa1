"""GIF media columns: decoding into timed frames with colour histograms, and lossless storage of bytes as GIF samples.

``decode_gif`` reads GIF87a and GIF89a: LZW code streams, global and local palettes, interlacing, transparency and the
disposal rules, and gives each frame as the canvas stands when it is shown. LZW is decoded without a loop over codes.
Code ``258 + j`` (for 8-bit samples) repeats what the j-th code since the last clear wrote, and one sample more; so its
length is one more than the j-th code's, and each of its samples is a copy of one written before. Lengths follow from
pointer doubling over codes, samples from pointer doubling over output places.

``encode_gif`` writes bytes as 8-bit samples of a 256-colour animation, ``WIDTH`` samples to a row and at most ``ROWS``
rows to a frame, with the usual greedy LZW.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from ._shared import stored

WIDTH, ROWS = 192, 4096
PAD = 192
DELAY_CS = 10
#: Codes of 8-bit samples between two clear codes, until the table's 4096 entries are taken.
FULL = 4096 - 258
#: Bytes of media that a batch of results holds at most (and one row at least).
BATCH_BYTES = 8 << 20

_index = np.arange(256)
#: Three bits of red, three of green, two of blue: each of the 256 samples has a colour of its own.
PALETTE = np.stack([_index & 0xE0, (_index << 3) & 0xE0, (_index << 6) & 0xC0], axis=1).astype(np.uint8)


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of the first ``n`` codes after a clear code, for samples of ``size`` bits."""
    k = np.arange(n) + (1 << size) + 1
    return np.minimum(12, np.maximum(size + 1, np.floor(np.log2(k)).astype(np.int64) + 1))


_ENCODE_WIDTHS = _widths(FULL + 1, 8)


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples: a clear code first and whenever the table is full, and the end code."""
    codes = [256]
    add = codes.append
    table: dict[int, int] = {}
    get = table.get
    free = 258
    prefix = data[0] if data else -1
    for sample in memoryview(data)[1:]:
        key = prefix << 8 | sample
        known = get(key)
        if known is not None:
            prefix = known
            continue
        add(prefix)
        table[key] = free
        free += 1
        prefix = sample
        if free == 4096:
            add(256)
            table.clear()
            free = 258
    if data:
        add(prefix)
    add(257)
    code = np.array(codes, dtype=np.int64)
    width = np.concatenate([[9], np.resize(_ENCODE_WIDTHS, len(code) - 1)])
    at = np.cumsum(width) - width
    value = code << (at & 7)
    byte = at >> 3
    size = int(at[-1] + width[-1] + 7) >> 3
    # no two codes share a bit, so sums are unions
    out = sum(np.bincount(byte + k, weights=(value >> (8 * k)) & 255, minlength=size + 3) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def _expand(code: np.ndarray, clear: int) -> np.ndarray:
    """The samples that the codes between two clear codes stand for."""
    n = len(code)
    place = np.arange(n)
    entry = code - (clear + 2)
    literal = code < clear
    if not (literal | ((entry >= 0) & (entry < place))).all():
        raise ValueError("an LZW code stands before its entry")
    jump = np.where(literal, place, entry)
    more = (~literal).astype(np.int64)
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        more += more[jump]
        jump = further
    length = more + 1
    start = np.cumsum(length) - length
    back = np.where(literal, 0, start - start[np.where(literal, 0, entry)])
    source = np.arange(int(start[-1] + length[-1])) - np.repeat(back, length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    value = np.zeros(len(source), dtype=np.uint8)
    value[start[literal]] = code[literal]
    return value[source]


def lzw_decode(stream: bytes, size: int, most: int) -> np.ndarray:
    """Samples of a code stream, up to ``most``; ValueError where the stream isn't valid. A stream that breaks off
    gives what it has."""
    clear = 1 << size
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8)
    bits = 8 * len(stream)
    parts, have, at, span = [], 0, 0, (1 << 12) - clear
    while have < most and at + size + 1 <= bits:
        count = span
        while True:
            width = _widths(count, size)
            begin = at + np.cumsum(width) - width
            fits = int(np.searchsorted(begin + width, bits, side="right"))
            begin, width = begin[:fits], width[:fits]
            byte = begin >> 3
            code = (data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16) >> (begin & 7) & ((1 << width) - 1)
            ends = np.flatnonzero((code == clear) | (code == clear + 1))
            if len(ends) or fits < count:
                break
            count *= 4  # an encoder may go on with a full table
        stop = int(ends[0]) if len(ends) else fits
        if stop:
            got = _expand(code[:stop], clear)
            parts.append(got)
            have += len(got)
        if not len(ends) or code[stop] == clear + 1:
            break
        at = int(begin[stop] + width[stop])
    return np.concatenate(parts)[:most] if parts else np.zeros(0, dtype=np.uint8)


def _blocks(data: bytes) -> bytes:
    """``data`` in sub-blocks of up to 255 bytes, each after its length, and the empty one that ends them."""
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes) -> bytes:
    """``payload``, of a positive multiple of ``WIDTH`` bytes, as a GIF89a animation."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"the payload must have a positive multiple of {WIDTH} bytes")
    step = WIDTH * ROWS
    height = min(ROWS, len(payload) // WIDTH)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), PALETTE.tobytes()]
    for k in range(0, len(payload), step):
        part = payload[k : k + step]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY_CS, 0, 0), struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0, 8), _blocks(lzw_encode(part))]
    return b"".join(out) + b";"


@dataclass
class Frame:
    """A frame: its place and samples, and the whole canvas (height, width, RGBA) while it is shown."""

    number: int
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order. ValueError if it isn't one or breaks off within a header; a code stream that breaks
    off leaves the rest of its frame transparent."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    try:
        yield from _frames(data)
    except (struct.error, IndexError) as e:
        raise ValueError("the GIF breaks off") from e


def _table(data: bytes, at: int, packed: int) -> tuple[np.ndarray, int]:
    n = 3 << ((packed & 7) + 1)
    rgba = np.zeros((256, 4), dtype=np.uint8)
    rgb = np.frombuffer(data[at : at + n], dtype=np.uint8)
    if len(rgb) < n:
        raise ValueError("the GIF breaks off")
    rgba[: n // 3, :3], rgba[: n // 3, 3] = rgb.reshape(-1, 3), 255
    return rgba, at + n


def _frames(data: bytes) -> Iterator[Frame]:
    width, height, packed = struct.unpack_from("<HHB", data, 6)
    at, shared, number = 13, np.zeros((256, 4), dtype=np.uint8), 0
    if packed & 0x80:
        shared, at = _table(data, at, packed)
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    disposal, delay, clear = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, after = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                flags, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = flags >> 2 & 7, index if flags & 1 else None
            at = after
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            colours = shared
            if flags & 0x80:
                colours, at = _table(data, at, flags)
            size = data[at]
            if not 1 <= size <= 11:
                raise ValueError("no such sample size")
            stream, at = _sub_blocks(data, at + 1)
            samples = lzw_decode(stream, size, w * h)
            shown = np.zeros((h * w, 4), dtype=np.uint8)
            shown.view(np.uint32)[: len(samples), 0] = colours.view(np.uint32)[samples, 0]
            seen = np.arange(h * w) < len(samples)
            if clear is not None:
                seen[: len(samples)] &= samples != clear
            shown, seen = shown.reshape(h, w, 4), seen.reshape(h, w)
            if flags & 0x40:
                order = np.concatenate([np.arange(first, h, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
                shown, seen = shown[np.argsort(order)], seen[np.argsort(order)]
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            fits = seen[: part.shape[0], : part.shape[1]]
            np.copyto(part, shown[: part.shape[0], : part.shape[1]], where=fits[..., None])
            yield Frame(number, left, top, w, h, delay * 10, disposal, clear, canvas.copy())
            number += 1
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = before
            disposal, delay, clear = 0, 0, None
        else:
            raise ValueError(f"no block starts with {kind}")


def histogram(canvas: np.ndarray) -> list[int]:
    """Opaque pixels by eight levels of red, eight of green and four of blue: 20 counts, one after another."""
    opaque = canvas[canvas[..., 3] > 0] if (canvas[..., 3] == 0).any() else canvas.reshape(-1, 4)
    return np.concatenate([np.bincount(opaque[:, k] >> (8 - bits), minlength=1 << bits) for k, bits in ((0, 3), (1, 3), (2, 2))]).tolist()


FRAMES = "frame int, delay_ms int, disposal int, transparent int, left int, top int, width int, height int, canvas_width int, canvas_height int, histogram array<long>, rgba binary, error string"


def gif_frames(media: DataFrame, id_col: str, gif_col: str, pixels: bool = True) -> DataFrame:
    """A row per frame of each GIF of ``media``: ``<id_col>`` and ``FRAMES``; ``rgba`` (null unless ``pixels``) is the
    canvas while the frame is shown, row by row.

    A null or malformed GIF gives the frames before the fault and then one row with ``error`` and null elsewhere; a GIF
    without frames gives no row. Rows with equal or null ids stay apart; other columns are ignored.
    """
    ship(media.sparkSession)
    kind = media.select(id_col).schema[0].dataType.simpleString()

    def rows(ident, data: bytes | None) -> Iterator[tuple]:
        try:
            if data is None:
                raise ValueError("null")
            for f in decode_gif(data):
                yield ident, f.number, f.delay_ms, f.disposal, f.transparent, f.left, f.top, f.width, f.height, f.canvas.shape[1], f.canvas.shape[0], histogram(f.canvas), f.canvas.tobytes() if pixels else None, None
        except ValueError as e:
            yield (ident, *[None] * 12, str(e))

    schema = f"`{id_col}` {kind}, {FRAMES}"
    return media.select(id_col, gif_col).mapInArrow(_by_row(rows, schema, lambda row: len(row[12] or b"")), schema)


def _by_row(rows, schema: str, weight):
    """A mapInArrow function from one that gives tuples for the values of a row; batches stay small."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for k in range(batch.num_rows):
                for row in rows(*[c[k].as_py() for c in columns]):
                    held.append(row)
                    size += 200 + weight(row)
                    if size > BATCH_BYTES or len(held) >= 2000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return run


def store_as_gif(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Writes every whole text of ``docs`` (null: empty) as a GIF to the shared folder and reads the table back:
    ``<id_col>, n_bytes, gif``. The stored bytes are UTF-8 and spaces up to a positive multiple of ``PAD`` bytes."""
    ship(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, gif binary"

    def rows(ident, data: bytes) -> Iterator[tuple]:
        short = -len(data) % PAD if data else PAD
        yield ident, len(data), encode_gif(data + b" " * short)

    made = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    return stored(made.mapInArrow(_by_row(rows, schema, lambda row: len(row[2])), schema), "gif")


#: A timed frame as it is stored; ``histogram`` is that of the whole canvas while it is shown.
FRAME = "struct<frame:int,delay_ms:int,disposal:int,transparent:int,left:int,top:int,width:int,height:int,histogram:array<long>>"


def payload_of(gif: bytes) -> tuple[bytes, list[tuple]]:
    """What ``encode_gif`` was given, and the timed frames (``FRAME``). The colours that each shown frame has in its own
    place are turned back to samples."""
    parts, frames = [], []
    for f in decode_gif(gif):
        own = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        parts.append((own[..., 0] | own[..., 1] >> 3 | own[..., 2] >> 6).tobytes())
        frames.append((f.number, f.delay_ms, f.disposal, f.transparent, f.left, f.top, f.width, f.height, histogram(f.canvas)))
    return b"".join(parts), frames


def media_columns(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A table in the shared folder with a row for each of ``store_as_gif``: its digests and ``frames``, the timed frames with
    their colour histograms."""
    ship(media.sparkSession)
    kind = media.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<{FRAME}>"
    names = [f.split(":")[0] for f in FRAME[len("struct<") : -1].replace("array<long>", "").split(",")]

    def rows(ident, n_bytes, gif) -> Iterator[tuple]:
        payload, frames = payload_of(gif)
        yield ident, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(gif), hashlib.sha256(gif).hexdigest(), [dict(zip(names, f)) for f in frames]

    return stored(media.select(id_col, "n_bytes", "gif").mapInArrow(_by_row(rows, schema, lambda row: 300 * len(row[7])), schema), "gif-frames")


def op2_media_gif(spark, sf_dir: str) -> DataFrame:
    """Every text through its GIF and back. ``feature`` is read from the stored frames: their number, how long they are shown in
    all, and the sums of their counts of red, green and blue levels."""
    media = media_columns(store_as_gif(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    zero = F.array_repeat(F.lit(0).cast("long"), 20)
    counts = F.aggregate("frames", zero, lambda sums, f: F.zip_with(sums, f.histogram, lambda x, y: x + y))
    shown = F.aggregate("frames", F.lit(0).cast("long"), lambda sums, f: sums + f.delay_ms)
    levels = [F.array_join(F.slice("counts", at, n), ",") for at, n in ((1, 8), (9, 8), (17, 4))]
    feature = F.concat_ws("|", F.size("frames").cast("string"), shown.cast("string"), *levels)
    return media.withColumn("counts", counts).withColumn("feature", feature).drop("frames", "counts")
