"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Each direction is a gated recurrent unit (reset gate after the recurrent product) whose input weights are a table with a
row per byte value. The states of both directions at a byte give, through a softmax layer, the probability of each
language at that byte, so every position is labelled. A document's probabilities are the mean over its letter bytes.
Texts are cut into windows of ``WINDOW`` bytes, each run from a zero state both ways; all windows of a batch advance
together, one lane each, so the cost per byte doesn't depend on how long the documents are.

Training is backpropagation through time with Adam on windows of a bounded sample of labelled documents: at most
``sample_docs`` different texts of each language, those with the smallest hashes, and ``windows`` windows of each. Every
labelled text counts for the bound of the hashes; languages aren't limited. One class more stands for what is in no
language: it is trained on random runs of letters and digits such as keys, codes and dumps have. It is never
predicted; its pooled probability is a document's ``noise``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from ._shared import beside

HIDDEN = 12
WINDOW = 128
LANES = 1024
TRAIN_WINDOW = 64
#: Position probabilities that are held at once: windows advance in fewer lanes where languages are many.
HELD = LANES * WINDOW * 16
#: Bounds of the fitted sample: documents a language, windows a document.
SAMPLE_DOCS, WINDOWS = 400, 8
#: Training steps at least, and for each language.
STEPS, STEPS_A_LANG, TRAIN_LANES, RATE = 300, 20, 256, 0.02
#: What random runs are drawn from, one of these each.
NOISE = (b"0123456789abcdef", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
UNKNOWN = "und"
#: The network reads A-Z as a-z, so that headlines are in their language too.
FOLD = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))

_value = np.arange(256)
#: Bytes that are or may be part of a letter: ASCII letters and all of multi-byte UTF-8.
IS_LETTER = (((_value | 32) >= 97) & ((_value | 32) <= 122) | (_value >= 128)).astype(np.float32)


@dataclass
class Model:
    """``table`` (2, 256, 3H): input weights and biases of reset, update and candidate; ``inner`` (2, 3H, H): recurrent
    weights; ``bias`` (2, H): the candidate's recurrent bias; ``out`` (K, 2H) and ``out_bias`` (K), where K is one more than
    the languages if the last class is noise; ``fitted``: windows of text that it was trained on."""

    langs: list[str]
    table: np.ndarray
    inner: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    fitted: int = 0

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias, self.out, self.out_bias]


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = 7, noise: bool = False) -> Model:
    r = np.random.default_rng(seed)
    normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    return Model(langs, normal(2, 256, 3 * hidden, scale=0.3), normal(2, 3 * hidden, hidden, scale=hidden**-0.5), np.zeros((2, hidden), np.float32), normal(len(langs) + noise, 2 * hidden, scale=0.3), np.zeros(len(langs) + noise, np.float32))


def _states(m: Model, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, 2H, lanes) of byte windows ``x`` (T, lanes). ``keep`` gets what the way back needs."""
    steps, lanes = x.shape
    h_size = m.inner.shape[2]
    out = np.empty((steps, 2 * h_size, lanes), dtype=np.float32)
    tables = [np.ascontiguousarray(m.table[d].T) for d in (0, 1)]
    for d in (0, 1):
        h = np.zeros((h_size, lanes), dtype=np.float32)
        bias = m.bias[d][:, None]
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            given = np.take(tables[d], x[t], axis=1)
            inner = m.inner[d] @ h
            gates = given[: 2 * h_size] + inner[: 2 * h_size]
            gates *= 0.5  # a sigmoid is a tanh of half the size
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            reset, update = gates[:h_size], gates[h_size:]
            recurrent = inner[2 * h_size :] + bias
            candidate = recurrent * reset
            candidate += given[2 * h_size :]
            np.tanh(candidate, out=candidate)
            if keep is not None:
                keep.append((d, t, h, gates, recurrent, candidate))
            h = h + update * (candidate - h)
            out[t, d * h_size : (d + 1) * h_size] = h
    return out


def position_probabilities(m: Model, x: np.ndarray) -> np.ndarray:
    """Probability (T, K, lanes) of each language at each byte of ``x`` (T, lanes)."""
    p = np.matmul(m.out, _states(m, x))
    p += m.out_bias[:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def gradients(m: Model, x: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy at the positions of ``mask`` (T, lanes) and its gradient by every weight, by
    backpropagation through time. ``label`` (lanes): the language of each window."""
    kept: list = []
    states = _states(m, x, kept)
    lanes, h_size = x.shape[1], m.inner.shape[2]
    scores = np.matmul(m.out, states) + m.out_bias[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=1, keepdims=True)
    weight = mask / max(1.0, float(mask.sum()))
    lane = np.arange(lanes)
    loss = float(-(np.log(p[:, label, lane] + 1e-9) * weight).sum())
    p[:, label, lane] -= 1.0
    p *= weight[:, None, :]
    g_out = np.einsum("tkl,thl->kh", p, states, optimize=True)
    g_out_bias = p.sum(axis=(0, 2))
    g_states = np.matmul(m.out.T, p)
    g_table, g_inner, g_bias = np.zeros_like(m.table), np.zeros_like(m.inner), np.zeros_like(m.bias)
    g_given = np.empty((2, x.shape[0], 3 * h_size, lanes), dtype=np.float32)
    carry, direction = np.zeros((h_size, lanes), dtype=np.float32), -1
    for d, t, h, gates, recurrent, candidate in reversed(kept):
        if d != direction:
            carry, direction = np.zeros_like(carry), d
        reset, update = gates[:h_size], gates[h_size:]
        g = g_states[t, d * h_size : (d + 1) * h_size] + carry
        g_candidate = g * update * (1 - candidate * candidate)
        g_update = g * (candidate - h) * update * (1 - update)
        g_reset = g_candidate * recurrent * reset * (1 - reset)
        g_recurrent = g_candidate * reset
        g_in = np.concatenate([g_reset, g_update, g_recurrent])
        g_inner[d] += g_in @ h.T
        g_bias[d] += g_recurrent.sum(axis=1)
        carry = g * (1 - update) + m.inner[d].T @ g_in
        g_given[d, t, : 2 * h_size], g_given[d, t, 2 * h_size :] = g_in[: 2 * h_size], g_candidate
    flat = x.reshape(-1)
    for d in (0, 1):
        by_place = g_given[d].transpose(1, 0, 2).reshape(3 * h_size, -1)
        g_table[d] = np.stack([np.bincount(flat, weights=row, minlength=256) for row in by_place], axis=1)
    return loss, [g_table, g_inner, g_bias, g_out.astype(np.float32), g_out_bias.astype(np.float32)]


def noise_windows(n: int, seed: int = 3) -> list[bytes]:
    """Random runs of letters and digits, with or without spaces between them."""
    r = np.random.default_rng(seed)
    found = []
    for k in range(n):
        data = np.frombuffer(NOISE[k % len(NOISE)], dtype=np.uint8)[r.integers(0, len(NOISE[k % len(NOISE)]), TRAIN_WINDOW)].copy()
        if k // len(NOISE) % 2:
            data[r.random(TRAIN_WINDOW) < 0.12] = 0x20
        found.append(data.tobytes())
    return found


def train(windows: list[bytes], labels: list[int], langs: list[str], steps: int | None = None, seed: int = 7, hidden: int = HIDDEN) -> Model:
    """Fits a model on ``windows``, of up to ``TRAIN_WINDOW`` bytes, whose languages are ``langs[label]``, and on noise.
    Languages weigh the same, however many windows they have. The result depends on the arguments only."""
    steps = steps or max(STEPS, STEPS_A_LANG * len(langs))
    m = new_model(langs, hidden, seed, noise=True)
    m.fitted = len(windows)
    r = np.random.default_rng(seed + 1)
    noise = noise_windows(SAMPLE_DOCS)
    windows, y = windows + noise, np.array([*labels, *[len(langs)] * len(noise)])
    x = np.zeros((len(windows), TRAIN_WINDOW), dtype=np.uint8)
    for k, w in enumerate(windows):
        x[k, : len(w)] = np.frombuffer(w[:TRAIN_WINDOW].translate(FOLD), dtype=np.uint8)
    of = [np.flatnonzero(y == k) for k in range(len(langs) + 1)]
    first, second = [np.zeros_like(w) for w in m.weights()], [np.zeros_like(w) for w in m.weights()]
    for step in range(1, steps + 1):
        lang = r.integers(0, len(of), TRAIN_LANES)
        pick = np.array([of[k][r.integers(0, len(of[k]))] for k in lang])
        at = np.ascontiguousarray(x[pick].T)
        _, grads = gradients(m, at, y[pick], IS_LETTER[at])
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for w, g, a, b in zip(m.weights(), grads, first, second):
            g = g * min(1.0, 5.0 / max(norm, 1e-12))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def predict(m: Model, texts: list[bytes], spans: bool = False) -> tuple[np.ndarray, np.ndarray, list | None]:
    """For each text its pooled probabilities (n, K), the share of its letter bytes that each class labels (n, K),
    and, if ``spans``, its labels as runs ``(start byte, length, class)``. A text without letters has zeros."""
    classes = len(m.out)
    counts = np.array([-(-len(t) // WINDOW) for t in texts], dtype=np.int64)
    total = int(counts.sum())
    sums, votes, letters = (np.zeros((total, classes)), np.zeros((total, classes)), np.zeros(total))
    flat = np.zeros(total * WINDOW, dtype=np.uint8)
    start = (np.cumsum(counts) - counts) * WINDOW
    for t, s in zip(texts, start):
        flat[s : s + len(t)] = np.frombuffer(t.translate(FOLD), dtype=np.uint8)
    best_all = np.zeros(total * WINDOW, dtype=np.int32) if spans else None
    step = max(16, min(LANES, HELD // (WINDOW * classes)))
    for a in range(0, total, step):
        x = np.ascontiguousarray(flat[a * WINDOW : (a + step) * WINDOW].reshape(-1, WINDOW).T)
        lanes = x.shape[1]
        p = position_probabilities(m, x)
        mask = IS_LETTER[x]
        p *= mask[:, None, :]
        best = p.argmax(axis=1)
        sums[a : a + lanes] = p.sum(axis=0).T
        letters[a : a + lanes] = mask.sum(axis=0)
        votes[a : a + lanes] = np.bincount((best + np.arange(lanes) * classes)[mask > 0], minlength=lanes * classes).reshape(lanes, classes)
        if spans:
            best_all[a * WINDOW : (a + lanes) * WINDOW] = best.T.reshape(-1)
    owner = np.repeat(np.arange(len(texts)), counts)
    pooled = np.stack([np.bincount(owner, weights=sums[:, k], minlength=len(texts)) for k in range(classes)], axis=1)
    voted = np.stack([np.bincount(owner, weights=votes[:, k], minlength=len(texts)) for k in range(classes)], axis=1)
    n = np.maximum(np.bincount(owner, weights=letters, minlength=len(texts)), 1.0)[:, None]
    runs = None
    if spans:
        runs = []
        for t, s in zip(texts, start):
            own = best_all[s : s + len(t)]
            cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]) if len(own) else np.zeros(1, dtype=int)
            runs.append([(int(x), int(y - x), int(own[x])) for x, y in zip(cut[:-1], cut[1:])])
    return pooled / n, voted / n, runs


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_windows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, windows: int = WINDOWS) -> tuple[list[bytes], list[int], list[str]]:
    """Windows of the bounded sample, their labels and the languages, from rows ``doc_id, text, lang`` that aren't held
    out and whose text and lang aren't null. At most ``sample_docs * windows`` windows of a language reach the driver,
    whatever rows repeat; they are chosen and cut on the executors."""
    ship(docs.sparkSession)
    mark = F.pmod(F.xxhash64(F.col("text"), F.lit(11)), F.lit(1 << 40))
    fit = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("text") != "")).select("lang", "text", mark.alias("mark"))
    # texts below a hash bound that is met by about twice those wanted; then the smallest hashes of these few
    bounds = fit.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n")).select("lang", (F.least(F.lit(1.0), F.lit(2 * sample_docs + 50) / F.col("n")) * (1 << 40)).cast("long").alias("bound"))
    # a row a language, as the model has: always small enough to be broadcast, so only the texts that are near move
    near = fit.join(F.broadcast(bounds), "lang").where("mark < bound").dropDuplicates(["lang", "mark"])
    order = Window.partitionBy("lang").orderBy("mark", "text")
    chosen = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs).select("lang", "mark", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"lang": [], "mark": [], "part": []}
            for lang, mark, text in zip(batch.column("lang").to_pylist(), batch.column("mark").to_pylist(), batch.column("text").to_pylist()):
                data = text.encode()
                r = np.random.default_rng(mark)
                for at in sorted(r.integers(0, max(1, len(data) - TRAIN_WINDOW + 1), windows)) if len(data) > TRAIN_WINDOW else [0]:
                    rows["lang"].append(lang), rows["mark"].append(mark), rows["part"].append(data[at : at + TRAIN_WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(rows["lang"], pa.string()), pa.array(rows["mark"], pa.int64()), pa.array(rows["part"], pa.binary())], names=["lang", "mark", "part"])

    got = sorted((r.lang, r.mark, bytes(r.part)) for r in chosen.mapInArrow(cut, "lang string, mark long, part binary").collect())
    names = sorted({lang for lang, _, _ in got})
    number = {k: i for i, k in enumerate(names)}
    return [part for _, _, part in got], [number[lang] for lang, _, _ in got], names


def fit_language_model(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int | None = None) -> Model | None:
    """Trains on the bounded sample of ``docs`` (``doc_id, text, lang``); None if nothing is labelled."""
    windows, labels, langs = training_windows(docs, sample_docs)
    return train(windows, labels, langs, steps) if windows else None


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", spans: bool = False) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score``, ``position_share``, ``noise`` and, if ``spans``, ``label_runs`` of every row.

    ``score`` is the pooled probability of ``lang_pred``; ``position_share`` the share of letter bytes labelled with it;
    ``noise`` the pooled probability of being in no language; ``label_runs`` the labels of all bytes of the UTF-8 text as
    ``(start, length, lang)``, null for noise. A text that is null or has no letter is ``und`` with score 0; so is every
    text without a model. Rows of equal or null ids stay apart, and other columns, whatever their names, are ignored;
    ``keep`` columns come first, and one whose name clashes with a result's can be kept inside a struct.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    given, kept = beside(docs, keep, F.when(text.rlike(r"\p{L}"), text).cast("binary"))
    results = T.StructType.fromDDL("lang_pred string, score double, position_share double, noise double" + ", label_runs array<struct<start:int,length:int,lang:string>>" * spans)
    schema = T.StructType([*kept, *results.fields])
    names = schema.fieldNames()
    held = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            column = whole.column(whole.num_columns - 1)
            sizes = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in column], dtype=np.int64) if whole.num_rows else np.zeros(0, np.int64)
            # slices of about 4 MB of text bound the memory
            part = np.cumsum(sizes) // (4 << 20)
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), whole.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
                lang, score, share, noise, runs = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts)), [[] for _ in texts]
                if m is not None:
                    pooled, voted, found = predict(m, texts, spans)
                    best = pooled[:, : len(m.langs)].argmax(axis=1)
                    row = np.arange(len(texts))
                    has = np.array([bool(t) for t in texts])
                    lang = [m.langs[k] if ok else UNKNOWN for k, ok in zip(best, has)]
                    score, share = np.clip(np.where(has, pooled[row, best], 0.0), 0, 1), np.where(has, voted[row, best], 0.0)
                    noise = np.clip(pooled[:, len(m.langs) :].sum(axis=1), 0, 1)
                    if spans:
                        runs = [[{"start": s, "length": n, "lang": m.langs[k] if k < len(m.langs) else None} for s, n, k in r] for r in found]
                columns = [batch.column(k) for k in range(len(kept))] + [pa.array(lang, pa.string()), pa.array(score), pa.array(share), pa.array(noise)]
                if spans:
                    columns.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return given.mapInArrow(run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language_model(docs.select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "position_share", "noise")
