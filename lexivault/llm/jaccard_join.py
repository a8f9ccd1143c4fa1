"""N-gram Jaccard self-join by a token-group matrix. Exact: no link between different texts is lost.

1. Each document's set of word shingles is hashed to 64 bits. Sets are cheaper to make than to move, so they are made
   again where they are needed. Tokens are ordered by the frequency of their rarest word, so runs of common words come
   last, and behind all of them those that a sample of the sets shows to be in many groups, by their count there, so
   that passages which many texts hold don't chain these, however rare their words are (only the order depends on
   counts; any order gives the same links).
2. Documents with equal sets are one class; from here on a class stands for its copies.
3. Classes are partitioned into groups of likely similar sets: those with the same three min-hashes.
4. The token-group matrix, first for whole groups: for each group the union of its members' prefix tokens. A set's prefix
   is its first ``n - ceil(t n) + DEPTH`` tokens in the common order; two sets with similarity ``t`` share at least
   ``DEPTH`` of them (or all that the smaller overlap allows). Groups that share fewer columns stay closed for each
   other. A token that more than ``SHARED`` groups have links each to its first: it costs a row a group.
5. Chains of groups that may hold links are cut into blocks, a task each. A task stores the whole token union of each of
   its groups as a sparse matrix. A query set's tokens select matrix rows, whose sums bound its overlap with every group
   at once; only groups that reach the overlap that a link needs are opened, and only their members are compared.
6. Chains of several blocks: a text is read once in its block; one set of each component found there is compared with
   those of the chain's other blocks; and what then isn't in the chain's largest component is compared, as queries,
   with all of its blocks. So a family of near copies, however large, costs one reading and its stragglers.
7. Components follow from star edges of the tasks' local components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from ._shared import connected_components, release, stored

#: Tokens that two prefixes must share.
DEPTH = 4
#: Frequent words that the order of tokens goes by. Part of the plan, not of the result.
MOST_HEAVY = 200_000
#: Documents, and words, that are counted together for that, and occurrences among them from which a word counts as frequent.
COUNTED, COUNTED_WORDS, OFTEN = 6000, 1_500_000, 3
#: One text of so many is a sample of the tokens; one set of each group counts in a task, and tokens with ``OFTEN`` of them
#: are frequent. At most ``MOST_HOT`` are held, by 32 bits of their hash; they are counted in ``BUCKETS``.
SAMPLED, MOST_HOT, BUCKETS = 8, 1_000_000, 1024
#: Groups of a token from which it opens all of them for one another instead of counting for each two.
SHARED = 64
#: A size beyond all sets, of which DEPTH common tokens are asked.
FAR = 1 << 40
#: Tokens and sets of a verifying task's block.
BLOCK_TOKENS, BLOCK_SETS = 1_000_000, 512
#: Rows of the token-group matrix in a partition.
MATRIX_ROWS = 1_500_000
#: Bits of the map of sets that may link: at most 16 MB are collected and broadcast.
BITS = 1 << 27
SALT = 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[0x09:0x0E] = 0x20
_FOLD = _FOLD.tobytes()
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_STEP_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(64).integers(0, 1 << 64, 256, dtype=np.uint64)
_MIX = np.random.default_rng(65).integers(0, 1 << 64, 8, dtype=np.uint64) | _U(1)
SEGMENT = 1 << 20
_powers: list[np.ndarray] = []


def mix64(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash: xor-shifts and odd multiplications."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 1)
        _powers[:] = [np.concatenate([[_U(1)], np.full(size - 1, base)]).cumprod(dtype=np.uint64) for base in (_STEP, _STEP_INVERSE)]
    return _powers


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lower-cased, in order."""
    data = text.translate(_FOLD)
    parts, at = [], 0
    while at < len(data):
        end = len(data) if len(data) - at <= SEGMENT else data.rfind(b" ", at, at + SEGMENT) + 1 or (data.find(b" ", at + SEGMENT) + 1 or len(data))
        parts.append(_segment(np.frombuffer(data[at:end], dtype=np.uint8)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def _segment(b: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(b) + 1)
    inside = np.concatenate([[False], b != 0x20, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([[_U(0)], np.cumsum(_BYTES[b] * up[: len(b)], dtype=np.uint64)])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    return np.unique(_shingle_hashes(words, min(k, len(words))))


def _shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    h = mix64(words[: len(words) - width + 1] + _U(width))
    for j in range(1, width):
        h = mix64(h * _MIX[1] + words[j : len(words) - width + 1 + j])
    return h


def ranked_shingles(words: np.ndarray, k: int, often: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` and how frequent each may be: the count of its rarest word, 0 where that isn't among the words
    ``often`` (sorted). A shingle is no more frequent than its words, and no count of shingles is needed to know that."""
    if not len(words):
        return words, np.zeros(0, dtype=np.int64)
    level = np.zeros(len(words), dtype=np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, words), len(often) - 1)
        level = np.where(often[at] == words, times[at], 0)
    width = min(k, len(words))
    s, first = np.unique(_shingle_hashes(words, width), return_index=True)
    least = level[: len(words) - width + 1]
    for j in range(1, width):
        least = np.minimum(least, level[j : len(words) - width + 1 + j])
    return s, least[first]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n`` of the words that are frequent among some thousand documents of a task."""
    seen: list[np.ndarray] = []
    held = 0

    def often() -> pa.RecordBatch:
        word, count = np.unique(np.concatenate(seen), return_counts=True)
        keep = count >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(word[keep].view(np.int64)), pa.array(count[keep])], names=["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            seen.append(word_hashes(text.as_buffer().to_pybytes()))
            held += len(seen[-1])
            if len(seen) >= COUNTED or held > COUNTED_WORDS:
                yield often()
                seen, held = [], 0
    if seen:
        yield often()


def _sample_tokens(k: int):
    """``bucket, tokens``: 32 bits of the tokens of one set of each group of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: set[int] = set()
        seen: list[np.ndarray] = []
        held = 0

        def dealt() -> pa.RecordBatch:
            token = np.sort((np.concatenate(seen) >> _U(32)).astype("<u4"))
            edge = np.searchsorted(token, np.arange(BUCKETS + 1) * ((1 << 32) // BUCKETS))
            some = np.flatnonzero(np.diff(edge))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([token[edge[b] : edge[b + 1]].tobytes() for b in some.tolist()], pa.binary())], names=["bucket", "tokens"])

        for batch in batches:
            for text in batch.column("text"):
                s = shingles(word_hashes(text.as_buffer().to_pybytes()), k)
                if (g := group_key(s)) not in groups:
                    groups.add(g)
                    seen.append(s)
                    held += len(s)
                if held > COUNTED_WORDS:
                    yield dealt()
                    seen, held = [], 0
        if held:
            yield dealt()

    return run


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, n`` of the frequent ones, from rows sorted by ``bucket``."""
    bucket, seen = None, []

    def often() -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(seen), return_counts=True)
        keep = count >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(token[keep].astype(np.int64)), pa.array(count[keep])], names=["token", "n"])

    for batch in batches:
        for b, tokens in zip(batch.column("bucket").to_pylist(), batch.column("tokens")):
            if b != bucket and seen:
                yield often()
                seen = []
            bucket = b
            seen.append(np.frombuffer(tokens.as_buffer().to_pybytes(), dtype="<u4"))
    if seen:
        yield often()


def first_tokens(s: np.ndarray, level: np.ndarray, hot: np.ndarray, times: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of a set's tokens in the common order: those that aren't ``hot`` (32 bits of them, sorted) by
    level and hash, then the others by their count ``times`` and hash."""
    s = s[np.argsort(level, kind="stable")]
    if not len(hot):
        return s[:most]
    for end in (2 * most, len(s)):  # what comes later rarely matters
        head = s[:end]
        token = (head >> _U(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
        is_hot = hot[at] == token
        cold = head[~is_hot][:most]
        if len(cold) == most:
            return cold
    late = head[is_hot]
    return np.concatenate([cold, late[np.lexsort((late, times[at[is_hot]]))][: most - len(cold)]])


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    return tuple(int(mix64(s * m).sum(dtype=np.uint64).astype(np.int64)) for m in _MIX[2:4])


def group_key(s: np.ndarray) -> int:
    """A hash of three min-hashes of a set; 0 for the empty one."""
    if not len(s):
        return 0
    h = np.zeros(1, dtype=np.uint64)
    for m in _MIX[4:7]:
        h = mix64(h * _MIX[1] + (s * m).min())
    return int(h.astype(np.int64)[0])


_PREFIXED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("g", pa.int64()), ("prefix", pa.list_(pa.int64()))])


def _make_prefixes(k: int, num: int, den: int, heavy):
    """Size, fingerprint, group and prefix of each document's set. ``heavy``: the broadcast frequent words, sorted, and
    their counts, and the same of frequent tokens; the common order is that of ``first_tokens``, a shingle's level being
    the count of its rarest word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times, hot, hot_times = heavy.value
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                rows, found = [], []
                for text in batch.column("text"):
                    s, level = ranked_shingles(word_hashes(text.as_buffer().to_pybytes()), k, often, times)
                    found.append(first_tokens(s, level, hot, hot_times, int(prefix_length(len(s), num, den))).view(np.int64))
                    rows.append((len(s), *fingerprint(s), group_key(s)))
                offsets = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *[pa.array(c, pa.int64()) for c in zip(*rows)], lists], schema=_PREFIXED)

    return run


def prefix_length(n: np.ndarray | int, num: int, den: int, depth: int = DEPTH):
    return np.minimum(n, n - -(-n * num // den) + depth)


def _open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups that share tokens, from the rows ``token, g, lo, hi, num, den`` of all tokens of a partition."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    token, g, lo, hi = (table.column(c).to_numpy() for c in ("token", "g", "lo", "hi"))
    num, den = int(table.column("num")[0].as_py()), int(table.column("den")[0].as_py())
    del table, parts
    order = np.lexsort((g, token))
    token, g, lo, hi = token[order], g[order], lo[order], hi[order]
    first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (g[1:] != g[:-1])]))
    token, g, lo, hi = token[first], g[first], np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.diff(np.concatenate([start, [len(token)]]))
    rest = np.repeat(start + count, count) - np.arange(len(token)) - 1  # later groups of the same token
    own = np.repeat(count, count)
    rest[own > SHARED] = 0
    held, size = [], 0
    # a token of many groups links each to its first: two sets that share such a token meet in one chain, and those that
    # share none are counted pair by pair. So rows grow with a token's groups, not with their square.
    many = np.flatnonzero(own > SHARED)
    many = many[~np.isin(many, start)]
    if len(many):
        first = np.repeat(start, count)[many]
        held += [(g[first], g[many], np.full(len(many), FAR), np.full(len(many), FAR))] * DEPTH

    def flush() -> Iterator[pa.RecordBatch]:
        a, b, x, y = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((b, a))
        a, b, x, y = a[order], b[order], x[order], y[order]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        c = np.diff(np.concatenate([cut, [len(a)]]))
        table = pa.Table.from_arrays([pa.array(v) for v in (a[cut], b[cut], c, np.minimum.reduceat(x, cut), np.minimum.reduceat(y, cut))], names=["a", "b", "c", "lo_a", "lo_b"])
        yield from table.to_batches(max_chunksize=100_000)

    if held:  # apart from counted pairs, so that their sizes stay FAR
        yield from flush()
        held = []

    # a slice of rows at a time, so that memory stays bounded whatever the number of pairs
    upto = np.cumsum(rest)
    at = 0
    while at < len(token):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 300_000, side="right")))
        n = rest[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        fits = (hi[i] * den >= lo[j] * num) & (hi[j] * den >= lo[i] * num)
        if fits.any():
            held.append((g[i[fits]], g[j[fits]], lo[i[fits]], lo[j[fits]]))
            size += int(fits.sum())
        if size > 1_000_000:
            yield from flush()
            held, size = [], 0
        at = end
    if held:
        yield from flush()


def link_sets(sets: list[np.ndarray], group: np.ndarray, label: np.ndarray, query: np.ndarray, target: np.ndarray, num: int, den: int) -> np.ndarray:
    """Component labels of ``sets`` (sorted token arrays) after linking queries with targets whose
    ``den * intersection >= num * union``. ``group``: each set's group; ``label``: components known before (numbers of
    sets); ``query`` and ``target``: masks. Sets of one component aren't compared, nor are two sets twice.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    start = np.cumsum(n) - n
    owner = np.repeat(np.arange(m), n)
    order = np.lexsort((code, df[code], owner))  # each set's tokens, rarest first
    # the token-group matrix: whole unions of the targets' groups, by token and by group
    _, number = np.unique(group, return_inverse=True)
    groups = int(number.max()) + 1
    pair = np.unique(code[target[owner]] * groups + number[owner[target[owner]]])
    by_token = pair % groups
    row = np.searchsorted(pair // groups, np.arange(len(df) + 1))
    column = np.argsort(by_token, kind="stable")
    union = (pair // groups)[column]
    edge = np.searchsorted(by_token[column], np.arange(groups + 1))
    low, high = np.full(groups, FAR), np.zeros(groups, dtype=np.int64)
    np.minimum.at(low, number[target], n[target])
    np.maximum.at(high, number[target], n[target])
    label = label.copy()
    floor = -(-n * num // den)
    width = prefix_length(n, num, den)
    mark = np.zeros(len(df), dtype=bool)
    waiting = target.copy()
    symmetric = bool((query == target).all())  # then a set that has asked needn't be asked
    for i in np.flatnonzero(query)[np.argsort(np.abs(n[query] - np.median(n)), kind="stable")].tolist():
        waiting[i] &= not symmetric
        other = waiting & (label != label[i])
        if not other.any():
            if (label == label[i]).all():
                break
            continue
        left = np.bincount(number[other], minlength=groups) > 0
        # least overlap with a member of each group that the sizes allow
        need = -(-num * (n[i] + np.maximum(low, floor[i])) // (num + den))
        left &= (high >= floor[i]) & (n[i] * den >= low * num)
        head = code[order[start[i] : start[i] + width[i]]]
        met = np.bincount(np.concatenate([by_token[row[t] : row[t + 1]] for t in head.tolist()]), minlength=groups)
        left &= met + (n[i] - width[i]) >= need
        if not left.any():
            continue
        own = code[start[i] : start[i] + n[i]]
        mark[own] = True
        opened = [g for g in np.flatnonzero(left).tolist() if mark[union[edge[g] : edge[g + 1]]].sum() >= need[g]]
        is_open = np.zeros(groups, dtype=bool)
        is_open[opened] = True
        near = np.flatnonzero(other & is_open[number] & (n >= floor[i]) & (n[i] >= floor))
        overlap = np.array([int(mark[code[start[j] : start[j] + n[j]]].sum()) for j in near.tolist()], dtype=np.int64)
        mark[own] = False
        linked = near[den * overlap >= num * (n[near] + n[i] - overlap)]
        if len(linked):
            label[np.isin(label, label[linked])] = label[i]
    return label


_TASK = ("cluster", "bi", "bj")


def _link(k: int, num: int, den: int):
    """Links of the tasks ``cluster, bi, bj`` of rows ``cid, g, f1, f2, root, side, text``: ``cid, root`` of every set,
    root being the first of its component in the task. Of side 0 and 1 there are queries and targets, of side 2 both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, sets, out = None, [], [], []

        def close() -> None:
            if rows:
                cid, g, root, side = (np.array(c, dtype=np.int64) for c in zip(*rows))
                _, first, known = np.unique(root, return_index=True, return_inverse=True)
                label = link_sets(sets, g, first[known], side != 1, side != 0, num, den) if len(sets) > 1 else first[known]
                out.append((cid, cid[label]))

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in _TASK)))
            prints = list(zip(*(batch.column(c).to_pylist() for c in ("f1", "f2"))))
            for j, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cid", "g", "root", "side")))):
                if keys[j] != key:
                    close()
                    key, rows, sets = keys[j], [], []
                s = shingles(word_hashes(batch.column("text")[j].as_buffer().to_pybytes()), k)
                if fingerprint(s) == prints[j]:
                    rows.append(row)
                    sets.append(s)
            if sum(len(a) for a, _ in out) > 100_000:
                yield _edges(out)
                out = []
        close()
        if out:
            yield _edges(out)

    return run


def _edges(out: list) -> pa.RecordBatch:
    a, b = (np.concatenate(c) for c in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["cid", "root"])


def _components(edges: DataFrame, name: str) -> DataFrame:
    """``cid, component`` of the ends of ``edges`` (``cid, root``)."""
    edges = edges.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b"))
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    return connected_components(ends, edges, name).select(F.col("id").alias("cid"), F.col("component_id").alias("component"))


def _wanted(members: DataFrame):
    """A test of ``doc_id, h`` that all of ``members`` (``rep, h``) pass and few others, so that texts that can't link aren't
    moved: a bit map of ``BITS`` bits, made on the executors. With very many members it lets more through, never less."""
    bit = F.pmod(F.xxhash64("rep", "h"), F.lit(BITS))
    words = members.select(F.expr(f"cast(pmod(xxhash64(rep, h), {BITS}) div 32 as int)").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int")).alias("bits"))
    got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(BITS // 32, dtype=np.uint32)
    table[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    held = members.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def passes(place: pd.Series) -> pd.Series:
        at = place.to_numpy(np.int64)
        return pd.Series((held.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0)

    return lambda doc_id, h: passes(F.coalesce(F.pmod(F.xxhash64(doc_id, h), F.lit(BITS)), F.lit(0)))


def _blocks(members: DataFrame, name: str) -> DataFrame:
    """``cluster, <name>``: the blocks that the members of each cluster (``cluster, n``) are cut into."""
    return members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)), F.ceil(F.count("*") / F.lit(BLOCK_SETS))).cast("int").alias(name))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash`` of every row: documents are linked if ``den * intersection >= num *
    union`` holds for their sets of ``k``-word shingles, and ``component_id`` is the smallest doc_id reachable;
    ``text_hash`` is Spark's ``xxhash64`` of the text's UTF-8 bytes, of none for null.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text of fewer than ``k`` words is one shingle, the whole
    sequence; null texts and texts without words have the empty set and are linked with nothing. A row with a null
    doc_id is linked with nothing and has a null component_id. Rows that repeat a doc_id are rows of their own, each
    with the component of its own set. Extra columns are ignored, whatever their names; no rows give no rows.
    """
    spark = ship(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    given = given.withColumn("h", F.xxhash64("text"))
    counts = given.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.desc("n"), "word").limit(MOST_HEAVY).toPandas()
    often = most["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(often)
    some = given.where(F.pmod("h", F.lit(SAMPLED)) == 0).mapInArrow(_sample_tokens(k), "bucket int, tokens binary").repartition("bucket")
    counts = some.sortWithinPartitions("bucket").mapInArrow(_count_tokens, "token long, n long")
    hot = counts.orderBy(F.desc("n"), "token").limit(MOST_HOT).toPandas().sort_values("token")
    heavy = spark.sparkContext.broadcast((often[order], most["n"].to_numpy(np.int64)[order], hot["token"].to_numpy(np.uint32), hot["n"].to_numpy(np.int64)))
    sets = stored(given.mapInArrow(_make_prefixes(k, num, den, heavy), "doc_id long, h long, n long, f1 long, f2 long, g long, prefix array<long>"), "jaccard-sets")
    real = sets.where("n > 0 and doc_id is not null")
    found = real.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min_by("h", "doc_id").alias("h"), F.first("n").alias("n"), F.first("g").alias("g"), F.count("*").alias("copies"))
    classes = stored(found.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    rows = real.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0)).alias("n")).first().n

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            width = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy()
            g, n = (np.repeat(batch.column(c).to_numpy(), width) for c in ("g", "n"))
            order = np.lexsort((g, token))
            token, g, n = token[order], g[order], n[order]
            if len(token):
                cut = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (g[1:] != g[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (token[cut], g[cut], np.minimum.reduceat(n, cut), np.maximum.reduceat(n, cut))], names=["token", "g", "lo", "hi"])

    # copies have one group, and a batch names each of a group's tokens once, so a group of copies hardly adds to it
    shares = real.select("g", "n", "prefix").mapInArrow(matrix, "token long, g long, lo long, hi long").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // MATRIX_ROWS)), "token")
    pairs = shares.withColumns({"num": F.lit(num), "den": F.lit(den)}).mapInArrow(_open_groups, "a long, b long, c long, lo_a long, lo_b long")
    need = F.least(F.lit(DEPTH), F.ceil(F.greatest("lo_a", "lo_b") * num / F.lit(den))).cast("long")
    opened = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("lo_a").alias("lo_a"), F.min("lo_b").alias("lo_b")).where(F.col("c") >= need).select("a", "b")
    opened = stored(opened, "jaccard-open")
    release(spark)
    groups = classes.groupBy("g").agg(F.count("*").alias("members"))
    touched = opened.select(F.col("a").alias("id")).union(opened.select("b")).distinct()
    chained = connected_components(touched, opened, "jaccard-chains").select(F.col("id").alias("g"), F.col("component_id").alias("chain"))
    active = groups.join(chained, "g", "left").where("members > 1 or chain is not null").select("g", F.coalesce("chain", "g").alias("cluster"))
    members = stored(classes.select("cid", "rep", "h", "n", "f1", "f2", "g").join(active, "g"), "jaccard-members")
    blocks = stored(_blocks(members, "blocks"), "jaccard-blocks")
    block = lambda of: F.pmod(F.xxhash64("cid"), F.col(of)).cast("int")

    # the texts of the sets that may link: read and moved once, whatever is compared with them later
    wanted = given.where(_wanted(members)("doc_id", "h")).select(F.col("doc_id").alias("rep"), "h", "text")
    texts = wanted.join(members.select("cid", "rep", "h"), ["rep", "h"])
    texts = stored(texts.select("cid", "text").dropDuplicates(["cid"]), "jaccard-texts")
    release(spark)

    def linked(tasks: DataFrame, name: str) -> DataFrame:
        """``tasks``: ``cluster, bi, bj, cid, f1, f2, g, root, side``."""
        columns = (*_TASK, "side", "cid", "g", "f1", "f2", "root")
        placed = texts.join(stored(tasks.select(*columns), f"{name}-tasks"), "cid").select(*columns, "text")
        return stored(placed.repartition(*_TASK).sortWithinPartitions(*_TASK).mapInArrow(_link(k, num, den), "cid long, root long"), name)

    own = members.join(blocks, "cluster").withColumns({"bi": block("blocks"), "bj": F.lit(0), "root": F.col("cid"), "side": F.lit(2)})
    links = linked(own, "jaccard-links").where("cid <> root")
    several = blocks.where("blocks > 1")
    if not several.isEmpty():
        within = members.join(several, "cluster")
        leaders = within.join(links.select(F.col("root").alias("cid")).distinct(), "cid", "left_semi")
        first = leaders.join(_blocks(leaders, "parts"), "cluster").withColumns({"bi": block("parts"), "bj": F.lit(0), "root": F.col("cid"), "side": F.lit(2)})
        links = links.union(linked(first, "jaccard-leaders").where("cid <> root"))
        known = _components(links, "jaccard-known").withColumnRenamed("component", "root")
        placed = stored(within.join(known, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "jaccard-placed")
        largest = placed.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
        stray = placed.join(largest, "cluster").where("root <> largest").drop("largest")
        parts = _blocks(stray, "parts")
        stray = stray.join(parts, "cluster").withColumns({"bi": block("parts"), "bj": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "side": F.lit(0)})
        # a chain without strays has no parts, and its texts stay where they are
        all_ = placed.join(parts, "cluster").withColumns({"bi": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "bj": block("blocks"), "side": F.lit(1)})
        links = links.union(linked(stray.unionByName(all_), "jaccard-strays").where("cid <> root"))
    release(spark)
    component = _components(links, "jaccard-components")
    smallest = component.join(classes.select("cid", "rep"), "cid").groupBy("component").agg(F.min("rep").alias("component_id"))
    # rows find their class by a salted key, as one class may hold a third of all rows
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALT)).cast("int")
    salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(salt("rep")))
    named = classes.select("f1", "f2", "rep", "copies", "cid").join(component.join(smallest, "component").select("cid", "component_id"), "cid", "left")
    named = named.select("f1", "f2", F.coalesce("component_id", "rep").alias("component_id"), F.explode(salts).alias("salt"))
    out = sets.select("doc_id", "h", "n", "f1", "f2", salt("doc_id").alias("salt")).join(named, ["f1", "f2", "salt"], "left")
    usable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(usable, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("h").alias("text_hash"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100).drop("text_hash")


#: Every pair of documents that share a shingle, by brute force.
ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM worded),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION
  SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, min(r.other) AS component_id FROM sets d JOIN reach r ON r.id = d.doc_id GROUP BY ALL
"""
