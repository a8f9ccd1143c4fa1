"""Fill-in-the-middle by an index of distinct texts.

1. Texts are packed where they are read, and rows with equal packed bytes are one text: the grouping key is the SHA-256
   and the bytes themselves, so equality is verified by content. From here on only packed texts move.
2. For each distinct text, once, the places at which its code points begin in UTF-8 are kept as an Elias-Fano list: they
   rise, so the low bits of each stand side by side and the high bits are a bit map with a one for each place. The
   place of every 1,024th one is kept too, so a look-up reads a bounded piece of the map.
3. Documents hold their text's SHA-256 only and join the index by it; a text of very many documents is dealt
   (``salted_join``), and one of a single document brings it along and isn't moved again.
4. Each document's two cuts follow from its seed and are selected from the list; the text is cut at bytes, never decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from ._shared import beside, named, salted_join, stored

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts of a hundred that are cut at all, and of those, of a hundred, that begin with the suffix.
CUT, SPM = 90, 20
#: Ones of a bit map between two kept places, and bytes of texts in a batch that leaves a task.
STEP, BATCH = 1024, 8 << 20


@dataclass(frozen=True)
class EliasFano:
    """A rising list of ``n`` integers below ``2^40``: ``bits`` low bits of each in ``low``, and in ``high`` a one at
    ``(value >> bits) + index``. ``jumps``: where every ``STEP``-th one is."""

    n: int
    bits: int
    low: bytes
    high: bytes
    jumps: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        bits = max(0, (int(values[-1] + 1) // n).bit_length() - 1) if n else 0
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        low = (values[:, None] >> np.arange(bits)) & 1
        return cls(n, bits, np.packbits(low.astype(np.uint8), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::STEP])

    def select(self, k: int) -> int:
        """The ``k``-th value, from 0."""
        start = int(self.jumps[k // STEP])
        stop = int(self.jumps[k // STEP + 1]) + 1 if k // STEP + 1 < len(self.jumps) else 8 * len(self.high)
        piece = np.unpackbits(np.frombuffer(self.high, np.uint8, (stop + 7) // 8 - start // 8, start // 8), bitorder="little")[start % 8 :]
        high = start + int(np.flatnonzero(piece)[k % STEP]) - k
        low = 0
        for b in range(self.bits):
            at = k * self.bits + b
            low |= (self.low[at >> 3] >> (at & 7) & 1) << b
        return (high << self.bits) | low


def boundaries(text: bytes) -> np.ndarray:
    """Where each code point of a text in UTF-8 begins, and the text's end."""
    data = np.frombuffer(text, dtype=np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def arrange(text: bytes, form: str, a: int, b: int) -> bytes:
    """The text cut at bytes ``a`` and ``b`` in the order of ``form``."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if form == "plain":
        return text
    return b"".join((p, text[:a], s, text[b:], m, text[a:b]) if form == "psm" else (s, text[b:], p, text[:a], m, text[a:b]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts end at the first of the next marker, which no cut text holds."""

    def parts(second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(4))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + 4)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + 4)

    prefix, suffix, middle = parts(SUFFIX)
    suffix2, prefix2, middle2 = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as its SHA-256, size and packed bytes; the others as they are."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        texts = [memoryview(v.as_buffer()) for v in batch.column(batch.num_columns - 1)]
        digests = [hashlib.sha256(t).digest() for t in texts]
        made = [pa.array(digests, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "digest", "size", "packed"])


def _unpack(packed, size: int) -> bytes:
    return pa.Codec("zstd").decompress(packed, decompressed_size=size, asbytes=True)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    for batch in batches:
        made = []
        for size, packed in zip(batch.column("size").to_pylist(), batch.column("packed")):
            text = _unpack(packed.as_buffer(), size)
            at = EliasFano.of(boundaries(text))
            made.append((at.n - 1, any(m in text for m in marks), at.bits, at.low, at.high, at.jumps))
        n, marked, bits, low, high, jumps = zip(*made) if made else ([],) * 6
        columns = [pa.array(n, pa.int64()), pa.array(marked, pa.bool_()), pa.array(bits, pa.int32()), pa.array(low, pa.binary()), pa.array(high, pa.binary()), pa.array(jumps, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "n", "marked", "bits", "low", "high", "jumps"])


def _packed(rows: DataFrame) -> DataFrame:
    """Rows whose last column is a text in bytes, with that text packed."""
    names = rows.columns[:-1]
    kept = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    return rows.mapInArrow(_pack, kept + "digest binary, size long, packed binary")


def _indexed(texts: DataFrame) -> DataFrame:
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(_index, kept + ", n long, marked boolean, bits int, low binary, high binary, jumps array<long>")


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``digest, size, packed, copies, n, marked, bits, low, high, jumps``: a row for each different text (null: empty), with
    its boundaries as an Elias-Fano list and whether it holds a marker."""
    texts = _packed(docs.select(F.coalesce(named(text_col), F.lit("")).cast("binary").alias("text")))
    return _indexed(texts.groupBy("digest", "size", "packed").agg(F.count("*").alias("copies")))


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, cut: int = CUT, spm: int = SPM) -> DataFrame:
    """``<id_col>, n, form, prefix_chars, middle_chars, output`` of every row: the text of ``n`` code points as prefix, suffix
    and middle after their markers.

    The four numbers that decide come from the SHA-256 of the seed and the id, so rows with equal ids and texts get equal
    cuts, and other partitionings change nothing. Plain are empty texts (null counts as empty), texts that hold a
    marker, and ``100 - cut`` of a hundred others; ``spm`` of a hundred of the rest begin with the suffix. A null id
    counts as an empty one. Rows stay apart whatever repeats; extra columns are ignored, whatever their names; no
    rows give no rows.
    """
    spark = ship(docs.sparkSession)
    given, kept = beside(docs, (id_col,), F.coalesce(named(text_col), F.lit("")))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("c0").cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    text = F.col("value").cast("binary")
    rows = stored(given.select("c0", F.unhex(F.sha2(text, 256)).alias("digest"), *numbers), "fim-rows")
    own = ("c0", "h1", "h2", "h3", "h4")
    texts = _packed(given.select("c0", *numbers, text.alias("text"))).groupBy("digest", "size", "packed").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in own])
    # a text of one document has that document's row with it; the others' documents are joined to it. Both take the same
    # columns of the grouping, so that it is made once
    alone = _indexed(texts.where("copies = 1").drop("copies"))
    joined = salted_join(rows, _indexed(texts.where("copies > 1").drop("copies")).drop(*own), "digest", name="fim").select(*alone.columns).unionAll(alone)
    first, second = (F.pmod(F.col(h), F.col("n") + 1) for h in ("h1", "h2"))
    form = F.when((F.col("n") == 0) | F.col("marked") | (F.pmod("h3", F.lit(100)) >= cut), "plain").when(F.pmod("h4", F.lit(100)) < spm, "spm").otherwise("psm")
    asked = joined.select("c0", "n", form.alias("form"), F.least(first, second).alias("a"), F.greatest(first, second).alias("b"), "digest", "size", "packed", "bits", "low", "high", "jumps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text, at = None, b"", None
        for batch in batches:
            out, held, since = [], 0, 0
            column = {c: batch.column(c) for c in batch.schema.names}
            forms, cuts = column["form"].to_pylist(), list(zip(column["a"].to_pylist(), column["b"].to_pylist()))
            for k in range(batch.num_rows):
                digest = column["digest"][k].as_py()
                if digest != last:  # rows of a text lie together after the join
                    last, text = digest, _unpack(column["packed"][k].as_buffer(), column["size"][k].as_py())
                    at = EliasFano(column["n"][k].as_py() + 1, column["bits"][k].as_py(), column["low"][k].as_py(), column["high"][k].as_py(), column["jumps"][k].values.to_numpy())
                a, b = cuts[k] if forms[k] != "plain" else (0, 0)
                out.append(arrange(text, forms[k], at.select(a), at.select(b)))
                held += len(out[-1])
                if held > BATCH or k == batch.num_rows - 1:
                    part = batch.slice(since, k + 1 - since)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("c0", "n", "form", "a", "b")), pa.array(out, pa.binary())], names=["c0", "n", "form", "a", "b", "output"])
                    out, held, since = [], 0, k + 1

    kind = kept[0].dataType.simpleString()
    made = asked.mapInArrow(run, f"c0 {kind}, n long, form string, a long, b long, output binary")
    chars = lambda c: F.when(F.col("form") != "plain", c)
    return made.select(F.col("c0").alias(id_col), "n", "form", chars(F.col("a")).alias("prefix_chars"), chars(F.col("b") - F.col("a")).alias("middle_chars"), F.col("output").cast("string").alias("output"))


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, [('0x' || substr(h, 1, 8))::BIGINT, ('0x' || substr(h, 9, 8))::BIGINT, ('0x' || substr(h, 17, 8))::BIGINT, ('0x' || substr(h, 25, 8))::BIGINT] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
