"""Packing by lexical retrieval: windows of one length, filled with documents that are close to their seed.

1. Every document is tokenized once; its ids are stored in the shared folder. The same pass counts, for every token id,
   the documents that have it, so the BM25 statistics (document frequencies, mean length) cover the whole corpus. Their
   size is that of the vocabulary.
2. Documents are dealt to shards of at most about ``SHARD_TOKENS`` tokens by their content: a tree over projections of
   a sample's BM25 vectors has leaves of a few sampled documents, every document falls into one, and leaves that follow
   one another in the tree's order make a shard. Only a leaf larger than a shard (a large group of copies, or of very
   similar documents) is dealt to several by a hash. A shard is one task, whatever the corpus' size, and holds an
   inverted index with BM25 impacts of its documents. A corpus of one shard is searched whole; beyond that a seed sees
   the documents on its own side of the tree's cuts, and the README says what part of its true neighbours these hold.
3. In a shard a seed opens a window. All its terms query the index, and unused neighbours fill the window, best first,
   as far down the ranking as it takes; of ``NEIGHBOURS`` at a time those that fit whole before one that is cut. What is cut off opens the next window, so only a shard's last
   window is padded. A document longer than a window fills whole windows of its own and opens one with the rest.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from ._shared import lean, stored

WINDOW, END_ID = 4096, 2
TOKENIZER = "word_bpe_49k.json"
SHARD_TOKENS = 4_000_000
#: Tokens that a document counts as at least when shards are filled, so that a shard of very short ones, whose windows all
#: look at its documents, has no more than about 31,000 of them.
LEAST_COUNTED = 128
#: Tasks that the shards are dealt to at most; beyond that a task takes several, one after another.
MOST_TASKS = 20_000
K1, B = 1.2, 0.75
#: Share of the documents, and documents at least and at most, that the tree is grown on, on the driver; documents of the
#: sample in a leaf at most; dimensions of the projections and their step as bytes.
SAMPLE, LEAST_SAMPLE, MOST_SAMPLE, LEAF, DIMENSIONS, STEP = 0.01, 2000, 500_000, 8, 64, 1 / 256
#: Neighbours that are tried at a time, before one that doesn't fit whole is cut.
NEIGHBOURS = 32
#: Terms that this part of a shard's documents have are held as whole rows of impacts.
OFTEN = 1 / 4
#: Token ids that are projected at a time, or one document's.
PROJECTED = 12_500
#: Entries of a tokenizer's cache of words that are merged on their own; two generations of half that.
CACHE = 200_000
#: Longer words aren't held.
LONGEST_HELD = 64
#: These are white space to Python and not to the tokenizers' pattern; texts with them are tokenized whole.
_ODD = re.compile("[\x1c-\x1f]")
#: Characters whose normal form, lower case and class are known without tables: ASCII and the letters of Latin-1.
_PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: The tokenizer's own pattern of pieces, a fixed value, and the same for lower-cased plain words.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: No piece holds white space, so this is free to end one.
END_OF_WORD = b" "
#: Signs that end a word as a piece: those of ASCII that begin no piece with letters and no special token.
_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Classes of characters, that of the last stands for all beyond, and what plain ones are lower-cased to. A word with a
#: strange character is merged on its own; signs of class ``MARK`` stand for it (``HOLE``) and for a text's end (``STOP``).
SPACE, LETTER, SIGN, DIGIT, MARK, STRANGE = range(6)
STOP, HOLE = 1, 2
_CLASS = np.array([SPACE if c.isspace() else STRANGE if not _PLAIN.fullmatch(c) else LETTER if c.isalpha() else DIGIT if c.isdigit() else SIGN for c in map(chr, range(0x3002))], dtype=np.uint8)
_LOWER = np.array([ord(chr(k).lower()) if LETTER <= c <= DIGIT else 32 for k, c in enumerate(_CLASS.tolist())], dtype=np.uint8)
#: Second and third character of the contractions that are pieces of their own.
_SHORT, _LONG = np.frombuffer(b"stmd", np.uint8), [tuple(x) for x in (b"re", b"ve", b"ll")]
GROUP_CHARS = 1 << 18
BATCH_BYTES = 4 << 20


class _Ids(dict):
    """Ids of words; a word that isn't held is made, and two generations bound the memory."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= LONGEST_HELD:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordTokenizer:
    """A ``tokenizers`` file whose pieces never span white space, with a bounded cache of the ids of words.

    The ids of a text are those of its words one after another: the normalizer turns white space into spaces, the
    pattern drops them, and each piece is merged on its own. ``encode`` gives the bytes of little-endian ids.

    Words of ASCII and Latin letters are merged by ``tiktoken``'s core, which is many times as fast. That gives the same
    ids where a merge's rank is its id's place and the merges of every vocabulary entry lead to it, an end of word being
    a blank; ``_quick`` is None for files of another kind. All other words, and texts with odd white space, go to
    ``tokenizers``. ``encode_all`` has the core merge all plain words of many texts in one call: what Python does for a
    word costs more than its merges, above all where a large table's many different words miss the cache.
    """

    def __init__(self, path: str, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._core = self._merger(path)
        self._quick = self._core and self._core.encode_single_piece
        self._held = _Ids(self._word, most)

    def _merger(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        model = about["model"]
        if model.get("type", "BPE") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("ignore_merges") or PIECES not in json.dumps(about["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
            return None
        merged = [self.tokenizer.token_to_id(a + b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        special = {t["content"] for t in about["added_tokens"]}
        if merged != list(range(merged[0], merged[0] + len(merged))):
            return None
        # the printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others follow 255
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(byte[c] for c in t.removesuffix("</w>")) + (END_OF_WORD if t.endswith("</w>") else b""): k for t, k in model["vocab"].items() if t not in special}
        if len(ranks) < len(model["vocab"].keys() - special) or any(bytes([m]) + END_OF_WORD not in ranks for m in (STOP, HOLE)):
            return None
        # with no special token at all, the core would look for an empty one at every place
        return tiktoken.Encoding(os.path.basename(path), pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={"\0": self.size})._core_bpe

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if self._quick is None or not _PLAIN.fullmatch(word) or "<|" in word:
            return self._direct(word)
        quick = self._quick
        if word.isalpha():  # one piece
            return array(self.dtype.char, quick(word.lower().encode() + END_OF_WORD)).tobytes()
        core = word.rstrip(_TAIL)
        if len(core) < len(word) and core[-1:].isalnum():  # signs after a letter or digit are a piece of their own
            return self._held[core] + self._held[word[len(core) :]]
        return array(self.dtype.char, [k for piece in _PIECE.findall(word.lower()) for k in quick(piece.encode() + END_OF_WORD)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        held = self._held.__getitem__
        return [self._direct(t) if _ODD.search(t) else b"".join(map(held, t.split())) for t in texts]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The same ids as ``encode``; plain words are cut into pieces, and merged, all at once."""
        if self._core is None or not texts:
            return self.encode(texts)
        odd = [k for k, t in enumerate(texts) if _ODD.search(t)]
        kept = texts
        if odd:
            kept = list(texts)
            for k in odd:
                kept[k] = ""
        whole = "\n".join([*kept, "", ""])  # two places follow every text
        try:
            code = np.frombuffer(whole.encode("latin-1"), dtype=np.uint8)
        except UnicodeEncodeError:
            code = np.minimum(np.frombuffer(whole.encode("utf-32-le"), dtype="<u4"), len(_CLASS) - 1)
        kind, low = _CLASS[code], _LOWER[code]
        words = self._cut_out(whole, kind, low)
        stop = np.cumsum([len(t) + 1 for t in kept]) - 1
        kind[stop], low[stop] = MARK, STOP
        ids = np.frombuffer(self._core.encode_to_tiktoken_buffer(_spaced(whole, kind, low), set()), dtype=np.uint32)
        end = np.flatnonzero(ids == self._quick(bytes([STOP]) + END_OF_WORD)[0])
        if words:
            made = list(map(self._held.__getitem__, words))
            hole = ids == self._quick(bytes([HOLE]) + END_OF_WORD)[0]
            count = np.ones(len(ids), dtype=np.int64)
            count[hole] = [len(m) // self.dtype.itemsize for m in made]
            ids, end = np.repeat(ids.astype(self.dtype), count), np.cumsum(count)[end] - 1
            ids[np.repeat(hole, count)] = np.frombuffer(b"".join(made), dtype=self.dtype)
        coded, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        begin = 0
        found = []
        for e in end.tolist():
            found.append(coded[begin * size : e * size])
            begin = e + 1
        for k in odd:
            found[k] = self._direct(texts[k])
        return found

    @staticmethod
    def _cut_out(whole: str, kind: np.ndarray, low: np.ndarray) -> list[str]:
        """Words with strange characters or the beginning of a special token; each leaves a hole."""
        strange = kind == STRANGE
        if "<|" in whole:
            strange[:-1] |= (low[:-1] == ord("<")) & (low[1:] == ord("|"))
        if not strange.any():
            return []
        space = np.concatenate([[True], kind == SPACE])
        edge = np.flatnonzero(space[1:] != space[:-1])
        some = np.concatenate([[0], np.cumsum(strange)])
        begin, end = edge[::2], edge[1::2]
        cut = some[begin] < some[end]
        begin, end = begin[cut], end[cut]
        inside = np.zeros(len(kind), dtype=np.int8)
        inside[begin], inside[end] = 1, -1
        inside = np.cumsum(inside, dtype=np.int8).astype(bool)
        kind[inside], low[inside] = SPACE, 32
        kind[begin], low[begin] = MARK, HOLE
        return [whole[b:e] for b, e in zip(begin.tolist(), end.tolist())]


def _spaced(whole: str, kind: np.ndarray, low: np.ndarray) -> str:
    """Lower-cased plain text with a blank after every piece: as ``_PIECE`` finds them in each word."""
    here, after = kind[:-1], kind[1:]
    cut = ((here != after) | (after >= DIGIT)) & (here != SPACE) & (after != SPACE)
    if "'" in whole:
        # a contraction begins a word or follows a letter, a digit or another one; after other signs it is one of them
        at = np.flatnonzero((low == ord("'")) & (np.concatenate([[SPACE], here]) != SIGN))
        long = np.zeros(len(at), dtype=bool)
        for a, b in _LONG:
            long |= (low[at + 1] == a) & (low[at + 2] == b)
        short = np.isin(low[at + 1], _SHORT)
        cut[at[short | long]] = False
        last = np.concatenate([at[short] + 1, at[long] + 2])
        cut[last] |= kind[last + 1] == LETTER
    place = np.flatnonzero(cut)
    spaced = np.full(len(low) + len(place), 32, dtype=np.uint8)
    own = np.ones(len(spaced), dtype=bool)
    own[place + np.arange(1, len(place) + 1)] = False
    spaced[own] = low
    return spaced.tobytes().decode("latin-1")


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(name: str) -> WordTokenizer:
    """The tokenizer of a path, or of a file's name among the public ones; one per Python worker."""
    if name not in _loaded:
        path = name
        if os.sep not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _loaded[name] = WordTokenizer(path)
    return _loaded[name]


def let_go() -> None:
    """Frees the tokenizers and their words, and gives what earlier tasks of this Python worker left back to the system."""
    _loaded.clear()
    lean()


_TOKENS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("df", pa.binary()), ("leaf", pa.int64())])


class Projection:
    """Documents' BM25 vectors of unit length in ``DIMENSIONS`` random directions, as bytes of ``STEP``."""

    def __init__(self, idf: np.ndarray, mean: float):
        self.idf, self.mean = idf, mean
        self.axes = np.random.default_rng(8).standard_normal((len(idf), DIMENSIONS), dtype=np.float32) / np.float32(DIMENSIONS**0.5)

    def of(self, docs: list[np.ndarray]) -> np.ndarray:
        """A row for each of the token id arrays ``docs``."""
        found = [self.of_terms(n, *terms) for n, terms in terms_of(docs, len(self.idf))]
        return np.concatenate(found) if found else np.zeros((0, DIMENSIONS), dtype=np.int8)

    def of_terms(self, n: np.ndarray, owner: np.ndarray, token: np.ndarray, tf: np.ndarray) -> np.ndarray:
        weight = (self.idf[token] * tf / (tf + K1 * (1 - B + B * n[owner] / self.mean))).astype(np.float32)
        start = np.searchsorted(owner, np.arange(len(n)))
        vector = np.add.reduceat(self.axes[token] * weight[:, None], start, axis=0)
        norm = np.sqrt(np.add.reduceat(weight * weight, start))
        return np.clip(np.rint(vector / (np.maximum(norm, 1e-9)[:, None] * STEP)), -127, 127).astype(np.int8)


def terms_of(docs: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Some documents at a time: their lengths and, for each of their terms in order, document, id and count."""
    at = 0
    while at < len(docs):
        end, tokens = at + 1, len(docs[at])
        while end < len(docs) and tokens + len(docs[end]) <= PROJECTED:
            tokens += len(docs[end])
            end += 1
        n = np.array([len(d) for d in docs[at:end]])
        pair = np.repeat(np.arange(end - at) * size, n) + np.concatenate(docs[at:end])
        pair.sort()
        cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        yield n, (*np.divmod(pair[cut], size), np.diff(np.append(cut, len(pair))))
        at = end


class Tree:
    """Cuts of a sample's projections, each where the values along the line between two means have their widest gap in
    the middle half. ``leaves`` gives the number of the leaf that each projection falls into, in the tree's order."""

    def __init__(self, sample: np.ndarray):
        points = np.unique(sample, axis=0).astype(np.float32)  # copies count once, and rows' order doesn't count
        self.line, self.cut, self.low, self.high = [], [], [], []
        self.size = 0
        # nodes are visited low side first, so leaves are numbered in the tree's order
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            if len(rows) <= LEAF:
                code, self.size = -1 - self.size, self.size + 1
            else:
                code = len(self.cut)
                line = self._line(points[rows])
                at = points[rows] @ line
                order = np.argsort(at, kind="stable")
                a, b = len(rows) // 4, 3 * len(rows) // 4
                k = a + int(np.argmax(np.diff(at[order[a : b + 1]])))
                self.line.append(line)
                self.cut.append((at[order[k]] + at[order[k + 1]]) / 2)
                self.low.append(0)
                self.high.append(0)
                todo += [(rows[order[k + 1 :]], code, 1), (rows[order[: k + 1]], code, 0)]
            if parent >= 0:
                (self.high if side else self.low)[parent] = code
        self.line = np.array(self.line, dtype=np.float32).reshape(-1, sample.shape[1])
        self.cut, self.low, self.high = np.array(self.cut, dtype=np.float32), np.array(self.low, dtype=np.int64), np.array(self.high, dtype=np.int64)

    @staticmethod
    def _line(points: np.ndarray) -> np.ndarray:
        a = points[np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1))]
        b = points[np.argmax(((points - a) ** 2).sum(axis=1))]
        for _ in range(4):
            near = points @ (a - b) > (a @ a - b @ b) / 2
            if near.all() or not near.any():
                break
            a, b = points[near].mean(axis=0), points[~near].mean(axis=0)
        return a - b

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), dtype=np.int64) if len(self.cut) else np.full(len(vectors), -1)
        vectors = vectors.astype(np.float32)
        while len(inner := np.flatnonzero(node >= 0)):
            at = node[inner]
            node[inner] = np.where(np.einsum("ij,ij->i", vectors[inner], self.line[at]) > self.cut[at], self.high[at], self.low[at])
        return -1 - node


def _tokenize(name: str, held=None):
    """``held``: a broadcast of idf, mean length and tree; without it all documents are in leaf 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        t = tokenizer(name)
        idf, mean, tree = held.value if held is not None else (None, 1.0, None)
        projection = Projection(idf, mean) if tree is not None else None
        end = np.array([END_ID], dtype=t.dtype).tobytes()
        df = np.zeros(t.size, dtype=np.int64)
        total = count = 0
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                group, chars = [], 0
                while at + len(group) < len(ids) and chars < GROUP_CHARS:
                    group.append(texts[at + len(group)].as_py())
                    chars += len(group[-1])
                codes = [coded + end for coded in t.encode_all(group)]
                owns = [np.frombuffer(coded, dtype=t.dtype) for coded in codes]
                vectors = []
                for n, terms in terms_of(owns, t.size):
                    df += np.bincount(terms[1], minlength=t.size)
                    if projection is not None:
                        vectors.append(projection.of_terms(n, *terms))
                leaf = tree.leaves(np.concatenate(vectors)).tolist() if vectors else [0] * len(owns)
                for doc, coded, own, place in zip(ids[at : at + len(group)], codes, owns, leaf):
                    total += len(own)
                    count += 1
                    # the order in a shard, and what deals a leaf that is larger than one
                    key = zlib.crc32(f"{doc},{count % 64}".encode()) << 31 ^ zlib.crc32(coded)
                    rows.append((doc, key, len(own), coded, None, place))
                    size += len(coded) + 60
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TOKENS)], schema=_TOKENS)
                        rows, size = [], 0
                        lean()
                at += len(group)
        if count:
            rows.append((None, count, total, None, df.tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TOKENS)], schema=_TOKENS)

    return run


def _sum_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for v in batch.column(0):
            own = np.frombuffer(v.as_buffer(), dtype=np.int64)
            total = own.copy() if total is None else total + own
    if total is not None:
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(total[token])], names=["token", "df"])


def _statistics(table: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Ids and documents of a token table, and the documents of each id."""
    sums = table.where("df is not null")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("key"), F.lit(0)).alias("docs")).first()
    counts = sums.select("df").mapInArrow(_sum_df, "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(size)
    df[counts["token"].to_numpy(np.int64)] = counts["df"].to_numpy(np.float64)
    return int(total.tokens), int(total.docs), df


def _idf(docs: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((docs - df + 0.5) / (df + 0.5))


_TABLE = "doc_id long, key long, n long, ids binary, df binary, leaf long"


def _grow(given: DataFrame, count: int, name: str) -> tuple[np.ndarray, float, Tree]:
    """The tree, and the statistics of its projections, by a sample that the rows' hashes choose."""
    t = tokenizer(name)
    share = min(max(SAMPLE, LEAST_SAMPLE / max(1, count)), MOST_SAMPLE / max(1, count), 1.0)
    some = given.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000))
    table = stored(some.mapInArrow(_tokenize(name), _TABLE), "packing-sample")
    tokens, docs, df = _statistics(table, t.size)
    idf, mean, dtype = _idf(docs, df), max(1.0, tokens / max(1, docs)), t.dtype.str
    held = given.sparkSession.sparkContext.broadcast((idf, mean))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection = Projection(*held.value)
        for batch in batches:
            vectors = [v.tobytes() for v in projection.of([np.frombuffer(v.as_buffer(), dtype=dtype) for v in batch.column(0)])]
            yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary())], names=["vector"])

    rows = table.where("df is null").select("ids").mapInArrow(project, "vector binary").toPandas()["vector"]
    return idf, mean, Tree(np.frombuffer(b"".join(map(bytes, rows)), dtype=np.int8).reshape(-1, DIMENSIONS))


def token_table(docs: DataFrame, id_col: str, text_col: str, name: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``doc_id, key, n, ids, df, leaf`` in the shared folder: a row per document with its ids (end id included) and its
    leaf and, at each task's end, one with the number of documents (``key``), of ids (``n``) and the documents of each id
    (``df``). Where the texts' bytes say that one shard holds all, there is one leaf."""
    spark = ship(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = given.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("bytes")).first()
    held = spark.sparkContext.broadcast(_grow(given, sizes.docs, name)) if sizes.bytes + LEAST_COUNTED * sizes.docs > shard_tokens else None
    return stored(given.mapInArrow(_tokenize(name, held), _TABLE), "packing-tokens")


def shards_of(leaves: list[tuple[int, int]], shard_tokens: int) -> list[tuple[int, int, int]]:
    """``leaf, first, parts`` for leaves and their tokens in order: leaves that follow one another share a shard up to
    ``shard_tokens``, and a larger one has ``parts`` shards of its own from number ``first``."""
    dealt: list[tuple[int, int, int]] = []
    shard, filled = -1, shard_tokens
    for leaf, tokens in leaves:
        parts = max(1, -(-tokens // shard_tokens))
        if parts > 1 or filled + tokens > shard_tokens:
            shard, filled = shard + 1, 0
        dealt.append((leaf, shard, parts))
        shard, filled = shard + parts - 1, shard_tokens if parts > 1 else filled + tokens
    return dealt


class Index:
    """A shard's inverted index: for each token id the documents that have it and their BM25 impacts."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n = np.array([len(d) for d in docs], dtype=np.int64)
        size = len(idf)
        pair = np.repeat(np.arange(len(docs), dtype=np.uint32 if len(docs) * size <= 1 << 32 else np.int64) * size, n)
        pair += np.concatenate(docs).astype(pair.dtype, copy=False)
        pair.sort()
        cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        tf = np.diff(np.concatenate([cut, [len(pair)]]))
        pair = pair[cut]
        self.owner, token = (pair // size).astype(np.int32), (pair % size).astype(np.int32)
        del pair
        impact = (idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[self.owner] / mean))).astype(np.float32)
        self.of = np.searchsorted(self.owner, np.arange(len(docs) + 1))
        self.token, self.own = token, impact
        order = np.argsort(token, kind="stable")
        self.docs, self.impact = self.owner[order], impact[order]
        count = np.bincount(token, minlength=size)
        self.start = np.concatenate([[0], np.cumsum(count)])
        self.n = len(docs)
        often = np.flatnonzero(count >= max(1, OFTEN * self.n))
        self.row = np.full(size, -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.n), dtype=np.float32)
        for k, t in enumerate(often.tolist()):
            at = slice(self.start[t], self.start[t + 1])
            self.rows[k, self.docs[at]] = self.impact[at]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 score of every document for all terms of ``doc``."""
        token = self.token[self.of[doc] : self.of[doc + 1]]
        row = self.row[token]
        score = np.add.reduce(self.rows[row[row >= 0]], axis=0).astype(np.float64)
        spans = [slice(self.start[t], self.start[t + 1]) for t in token[row < 0].tolist()]
        if spans:
            score += np.bincount(np.concatenate([self.docs[s] for s in spans]), weights=np.concatenate([self.impact[s] for s in spans]), minlength=self.n)
        return score


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of a shard, every id in exactly one."""
    index = Index(docs, idf, mean)
    length = [len(d) for d in docs]
    unused = np.ones(len(docs), dtype=bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, filled, following = 0, 0, 0
    seed = -1

    def put(doc: int, start: int, n: int) -> None:
        nonlocal sequence, filled
        pieces.append((doc, start, n, sequence, filled))
        filled += n
        if filled == window:
            sequence, filled = sequence + 1, 0

    def put_all(doc: int, start: int) -> bool:
        """Places the rest of a document; whether it leaves a window open."""
        while start < length[doc]:
            n = min(window - filled, length[doc] - start)
            put(doc, start, n)
            start += n
        return filled > 0

    while True:
        if not filled:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                return pieces
            seed = following
            unused[seed] = False
            if not put_all(seed, 0):
                continue
        score = np.where(unused, index.scores(seed), 0.0)
        best = -1
        positive = np.flatnonzero(score > 0)
        while filled and best < 0:
            near = positive = positive[score[positive] > 0]
            if not len(near):
                break
            if len(near) > NEIGHBOURS:
                near = near[score[near] >= -np.partition(-score[near], NEIGHBOURS - 1)[NEIGHBOURS - 1]]
            near = near[np.lexsort((near, -score[near]))][:NEIGHBOURS].tolist()
            for doc in near:
                if length[doc] <= window - filled:
                    unused[doc] = False
                    score[doc] = 0.0
                    put(doc, 0, length[doc])
                    if not filled:
                        break
            best = next((d for d in near if unused[d]), -1)
        if filled:
            # some of those tried don't fit whole: the best of them is cut, and its rest is the next window's seed
            if best < 0:
                while following < len(docs) and not unused[following]:
                    following += 1
                if following == len(docs):
                    return pieces
                best = following
            unused[best] = False
            put_all(best, 0)
            seed = best


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if ``with_ids``,
    the piece's ``ids``. Sequences are gapless from offset 0 and have ``window`` ids but for the last of each shard.

    A null or empty text is its end id alone. Rows that repeat a doc_id, or have none, are packed each on their own;
    extra columns are ignored, whatever their names; no rows give no pieces.
    """
    spark = ship(docs.sparkSession)
    table = token_table(docs, id_col, text_col, name, shard_tokens)
    tokens, n_docs, df = _statistics(table, tokenizer(name).size)
    mean = max(1.0, tokens / max(1, n_docs))
    held = spark.sparkContext.broadcast(_idf(n_docs, df))
    leaves = table.where("df is null").groupBy("leaf").agg(F.sum(F.greatest("n", F.lit(LEAST_COUNTED))).alias("n")).orderBy("leaf").collect()
    places = shards_of([(r.leaf, r.n) for r in leaves], shard_tokens)
    shards = max((first + parts for _, first, parts in places), default=1)
    dtype = tokenizer(name).dtype.str
    schema = _PIECES + ", ids binary" * with_ids

    def one(shard: int, ids: list, keys: list, docs_: list[np.ndarray]) -> list[pa.Array]:
        # the order within a shard is that of the keys, whatever order rows arrive in
        order = sorted(range(len(ids)), key=lambda k: (keys[k], ids[k] is None, ids[k] or 0, len(docs_[k])))
        ids, docs_ = [ids[k] for k in order], [docs_[k] for k in order]
        out = [(ids[d], s, n, zlib.crc32(docs_[d][s : s + n].astype("<u4").tobytes()), len(docs_[d]), shard << 32 | q, o, *([docs_[d][s : s + n].astype("<u4").tobytes()] if with_ids else [])) for d, s, n, q, o in pack_shard(docs_, held.value, mean, window)]
        return [pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        names = [f.split()[0] for f in schema.split(", ")]
        now, ids, keys, docs_ = None, [], [], []
        for batch in batches:
            for shard, doc, key, coded in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "key", "ids"))):
                if shard != now:
                    if docs_:
                        yield pa.RecordBatch.from_arrays(one(now, ids, keys, docs_), names=names)
                        ids = keys = docs_ = None
                        lean()
                    now, ids, keys, docs_ = shard, [], [], []
                ids.append(doc)
                keys.append(key)
                docs_.append(np.frombuffer(coded, dtype=dtype))
        if docs_:
            yield pa.RecordBatch.from_arrays(one(now, ids, keys, docs_), names=names)

    rows = table.where("df is null")
    if shards > 1:
        place = F.broadcast(spark.createDataFrame(places, "leaf long, first long, parts long"))
        rows = rows.join(place, "leaf").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts")))
    else:
        rows = rows.withColumn("shard", F.lit(0).cast("long"))
    dealt = rows.select("shard", "doc_id", "key", "ids")
    # shard numbers are dealt by range, which gives every task its share of them; equal hashes of a few numbers don't
    tasks = dealt.repartitionByRange(min(shards, MOST_TASKS), "shard") if shards > 1 else dealt.coalesce(1)
    return tasks.sortWithinPartitions("shard").mapInArrow(run, schema)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
