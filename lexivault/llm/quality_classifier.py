"""Document quality by regularised quadratic discriminant analysis.

1. Each whole text becomes ``FEATURES``: counts of bytes by kind and of words, and how much of the text repeats, as logarithms
   and as arcs of ratios, in whole numbers of 1/``GRID``. One pass over the texts; the rest works on this small table.
2. The labelled rows' counts, sums and sums of products, by class, are added up by Spark as exact whole numbers, so
   neither order nor partitioning changes a bit of the model. The driver gets one row per class and pair of features.
3. Each class covariance is shrunk towards the pooled one and that towards its mean variance (Friedman 1989), and factored
   once (Cholesky). Tasks get the inverse factors: a Mahalanobis distance is then one product and a sum of squares.
4. The score is the probability of label 1 by the difference of the two log densities and the classes' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from ._shared import beside, named, salted_join, stored

#: Whole numbers to one unit of a feature.
GRID = 1024
#: Words, lines or signs that every ratio counts besides those of the text.
FEW = 5
#: How far a class covariance is shrunk towards the pooled one, and that mixture towards its mean variance.
TOWARDS_POOLED, TOWARDS_SPHERE = 0.1, 0.005
#: Least variance of a feature, in square units: that of the grid and of what texts of one kind hardly vary in.
LEAST_VARIANCE = 1e-3
LEAST_SCORE = 0.3

#: Kinds of bytes: lower-case, upper-case, digits, blanks, line ends, marks of prose, other signs, control bytes, first bytes
#: of code points beyond ASCII, their other bytes.
KINDS = 10
LOWER, UPPER, DIGIT, BLANK, LINE, MARK, SIGN, CONTROL, FIRST, NEXT = range(KINDS)
FEATURES = ("length", "words", "word_length", "upper", "digit", "mark", "sign", "beyond", "blank", "control", "lines", "repeated_words", "repeated_pairs", "repeated_lines", "short_words", "sign_ends", "upper_words", "top_word")


def _table() -> np.ndarray:
    kind = np.full(256, SIGN, dtype=np.int64)
    for byte in range(256):
        c = chr(byte)
        if byte >= 0x80:
            kind[byte] = NEXT if byte < 0xC0 else FIRST
        elif c in "\n\r\v\f":
            kind[byte] = LINE
        elif c in " \t":
            kind[byte] = BLANK
        elif byte < 32 or byte == 127:
            kind[byte] = CONTROL
        elif c.isalpha():
            kind[byte] = LOWER if c.islower() else UPPER
        elif c.isdigit():
            kind[byte] = DIGIT
        elif c in ".,;:!?'\"()-":
            kind[byte] = MARK
    return kind


KIND = _table()


def _word_statistics(text: bytes) -> tuple[int, ...]:
    """Words, different ones, different pairs of neighbours, lines, different ones, words of three bytes or fewer, words that
    end in two signs or marks, words without a lower-case letter but with an upper-case one, places of the commonest word
    beyond the first three."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    ends = sum(n for w, n in counts.items() if len(w) > 1 and w[-1] < 128 and w[-2] < 128 and not w[-2:].isalnum() and KIND[w[-1]] in (MARK, SIGN) and KIND[w[-2]] in (MARK, SIGN))
    upper = sum(n for w, n in counts.items() if w.isupper() and len(w) > 1)
    top = sorted(counts.values(), reverse=True)[3:4]
    return len(words), len(counts), len(set(zip(words, words[1:]))), len(lines), len(set(lines)), sum(n for w, n in counts.items() if len(w) <= 3), ends, upper, top[0] if top else 0


def statistics(texts: list[bytes]) -> np.ndarray:
    """Whole-number features of texts in UTF-8, a row each."""
    if not texts:
        return np.zeros((0, len(FEATURES)), dtype=np.int64)
    size = np.array([len(t) for t in texts])
    count = np.zeros((len(texts), KINDS))
    for k, t in enumerate(texts):
        count[k] = np.bincount(KIND[np.frombuffer(t, np.uint8)], minlength=KINDS)
    words, distinct, pairs, lines, different, short, ends, upper, top = np.array([_word_statistics(t) for t in texts], dtype=float).T
    chars = size - count[:, NEXT]
    letters = count[:, LOWER] + count[:, UPPER] + count[:, FIRST]

    def arc(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Of a few words or signs a ratio says little: ``FEW`` more count as not being of the part."""
        return np.arcsin(np.sqrt(np.clip(part / (whole + FEW), 0, 1)))

    columns = (
        np.log1p(chars), np.log1p(words), np.log1p(letters / np.maximum(words, 1)), arc(count[:, UPPER], letters), arc(count[:, DIGIT], chars), arc(count[:, MARK], chars), arc(count[:, SIGN], chars),
        arc(count[:, FIRST], letters), arc(count[:, BLANK], chars), arc(count[:, CONTROL], chars), np.log1p(chars / np.maximum(lines, 1)), arc(words - distinct, words), arc(np.maximum(words - 1, 0) - pairs, words), arc(lines - different, lines),
        arc(short, words), arc(ends, words), arc(upper, words), arc(top, words),
    )
    return np.rint(np.stack(columns, axis=1) * GRID).astype(np.int64)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``c0`` (the id) and ``x`` (the features) of every row; null texts count as empty."""
    given, kept = beside(docs, (id_col,), F.coalesce(named(text_col), F.lit("")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1).to_pylist()).astype(np.int32)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["c0", "x"])

    return given.mapInArrow(run, f"c0 {kept[0].dataType.simpleString()}, x array<int>")


@dataclass
class Model:
    """Means, inverse Cholesky factors and log determinants of both classes, in features' units, and the log of their sizes'
    ratio. ``constant``: the score of all texts where a class has no rows."""

    means: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    prior: float
    constant: float | None = None

    @classmethod
    def of(cls, n: list[int], sums: list[list[int]], products: list[list[list[int]]], pooled: float = TOWARDS_POOLED, sphere: float = TOWARDS_SPHERE) -> Model:
        """By class: rows, sums of features and of their products, exact whole numbers on the grid."""
        d = len(FEATURES)
        empty = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
        if not (n[0] and n[1]):
            return cls(*empty, 0.0, 0.5 if not n[0] + n[1] else float(bool(n[1])))
        scatter = np.array([[[float(products[c][i][j] * n[c] - sums[c][i] * sums[c][j]) / n[c] for j in range(d)] for i in range(d)] for c in (0, 1)]) / GRID**2
        whole = (scatter[0] + scatter[1]) / (n[0] + n[1])
        means = np.array([[s / n[c] / GRID for s in sums[c]] for c in (0, 1)])
        factors = []
        for c in (0, 1):
            # Friedman's weights: a small class leans more on the pooled covariance
            own = ((1 - pooled) * scatter[c] + pooled * (scatter[0] + scatter[1])) / ((1 - pooled) * n[c] + pooled * (n[0] + n[1])) if pooled < 1 else whole
            shrunk = (1 - sphere) * own + sphere * np.trace(own) / d * np.eye(d)
            factors.append(np.linalg.cholesky(shrunk + LEAST_VARIANCE * np.eye(d)))
        return cls(means, np.array([np.linalg.inv(f) for f in factors]), np.array([2 * np.log(np.diag(f)).sum() for f in factors]), float(np.log(n[1]) - np.log(n[0])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of rows on the grid, rounded to nine places so that a batch's shape doesn't show."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [((((x / GRID - m) @ w.T) ** 2).sum(axis=1) + d) / -2 for m, w, d in zip(self.means, self.inverse, self.logdet)]
        return np.round(1 / (1 + np.exp(np.clip(density[0] - density[1] - self.prior, -700, 700))), 9)


def fit(rows: DataFrame, labels: DataFrame, pooled: float = TOWARDS_POOLED, sphere: float = TOWARDS_SPHERE) -> Model:
    """The model of rows ``c0, x`` whose id has one label, 0 or 1, in ``labels`` (``c0, label``); ids with null, other or
    disagreeing labels teach nothing. The driver gets a row per class and pair of features."""
    d = len(FEATURES)
    one = labels.where(F.col("c0").isNotNull()).groupBy("c0").agg(F.min("label").alias("label"), F.max("label").alias("high"), F.count("*").alias("n"), F.count("label").alias("m"))
    one = one.where((F.col("label") == F.col("high")) & (F.col("n") == F.col("m")) & F.col("label").isin(0, 1)).select("c0", F.col("label").cast("int").alias("label"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0, 0], np.zeros((2, d + 1, d + 1), dtype=object)
        for batch in batches:
            label = batch.column("label").to_numpy()
            x = np.column_stack([batch.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, d), np.ones(len(label), dtype=np.int64)])
            for c in (0, 1):
                n[c] += int((label == c).sum())
                total[c] += x[label == c].T @ x[label == c]  # below 2^31 each, a batch's sum fits
        rows = [(c, i, j, Decimal(int(total[c, i, j]))) for c in (0, 1) if n[c] for i in range(d + 1) for j in range(i + 1)]
        if rows:
            c, i, j, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s, pa.decimal128(38, 0))], names=["label", "i", "j", "s"])

    joined = salted_join(rows, one, "c0", most=1 << 16, name="quality").select("x", "label")
    found = joined.mapInArrow(gather, "label int, i int, j int, s decimal(38,0)").groupBy("label", "i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((2, d + 1, d + 1), dtype=object)
    for r in found:
        total[r.label, r.i, r.j] = total[r.label, r.j, r.i] = int(r.s)
    return Model.of([int(t[d, d]) for t in total], [list(t[d, :d]) for t in total], [t[:d, :d].tolist() for t in total], pooled, sphere)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, least: float = LEAST_SCORE) -> DataFrame:
    """``<id_col>, held_out, score, predicted`` of every row of ``docs``; ``labels`` has ``id_col`` and ``label_col``.

    Learns from rows that aren't held out (the CRC-32 of the id as text is no multiple of ``folds``) by text alone. Null and
    empty texts get the score of an empty text, equal texts equal scores. A null id isn't held out and teaches nothing;
    rows with equal ids each teach their id's label. With labels of one class all scores are 0 or 1, without labels 0.5.
    Extra columns are ignored, whatever their names; no rows give no rows.
    """
    ship(docs.sparkSession)
    rows = stored(document_statistics(docs, id_col, text_col).withColumn("held_out", F.coalesce(F.crc32(F.col("c0").cast("string").cast("binary")) % folds == 0, F.lit(False))), "quality-rows")
    kind = rows.schema["c0"].dataType
    model = fit(rows.where("not held_out").select("c0", "x"), labels.select(named(id_col).cast(kind).alias("c0"), named(label_col).cast("double").alias("label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("c0"), batch.column("held_out"), pa.array(model.scores(x))], names=["c0", "held_out", "score"])

    scored = rows.select("c0", "held_out", "x").mapInArrow(run, f"c0 {kind.simpleString()}, held_out boolean, score double")
    return scored.select(F.col("c0").alias(id_col), "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_quality(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
