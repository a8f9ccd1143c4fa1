"""BM25 over chunks.

A query's tree becomes columns over the token arrays of the three text columns: each phrase's number of occurrences, and
whether the tree matches. One aggregate over all chunks gives the statistics, which are never filtered; filters apply
to candidates only. No row is shuffled but the one of statistics and the top ``k``.

A stored index has postings instead: for every term and chunk the term's places in each column, in runs sorted by term. A query of any form then reads the rows of its own terms only, and gathers them by chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fts import COLUMNS, Node, Phrase, parse
from ..functions.text import tokens
from ..runtime import ship

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
RRF_K = 60
#: Rows of a batch that is put out.
OUT = 50_000


def postings(chunks: DataFrame) -> DataFrame:
    """``term, id, dl`` and the term's places, from 1, in each of the three columns, for every term of every chunk.

    A chunk's words stand in its row, so nothing is moved; each batch of chunks gives its rows by term."""
    ship(chunks.sparkSession)
    said = chunks.select("id", *[tokens(F.col(c)).alias(c) for c in COLUMNS])
    kind = said.schema["id"].dataType.simpleString()
    return said.mapInArrow(_placed, f"term string, id {kind}, dl long, " + ", ".join(f"{c} array<int>" for c in COLUMNS))


def coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words in order, and each word's place among them."""
    held = words.dictionary_encode()
    order = pc.sort_indices(held.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return held.dictionary.take(order), place[held.indices.to_numpy(zero_copy_only=False)]


def lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in COLUMNS]
        if not sum(int(n.sum()) for n in sizes):
            continue
        words, code = coded(pa.concat_arrays([batch.column(c).flatten() for c in COLUMNS]))
        row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
        place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1 for n in sizes])
        column = np.repeat(np.arange(len(COLUMNS)), [n.sum() for n in sizes])
        key = code * batch.num_rows + row
        order = np.argsort(key, kind="stable")  # places of a column stay in order
        found, at = np.unique(key[order], return_inverse=True)
        place, column = place[order], column[order]
        own = found % batch.num_rows
        held = [lists(np.bincount(at[column == k], minlength=len(found)), place[column == k], pa.int32()) for k in range(len(COLUMNS))]
        made = pa.RecordBatch.from_arrays([words.take(found // batch.num_rows), batch.column("id").take(own), pa.array(sum(sizes).astype(np.int64)[own]), *held], names=["term", "id", "dl", *COLUMNS])
        yield from (made.slice(k, OUT) for k in range(0, len(found), OUT))


def term_stats(chunks: DataFrame) -> DataFrame:
    """``term, docs, occurrences`` over all three columns."""
    words = chunks.select("id", F.explode(F.concat(*[tokens(F.col(c)) for c in COLUMNS])).alias("term"))
    return words.groupBy("term", "id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """``n, avgdl``: chunks, and their mean number of tokens."""
    size = reduce(lambda a, b: a + b, [F.size(tokens(F.col(c))) for c in COLUMNS])
    return chunks.select(size.cast("long").alias("dl")).agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))


def _phrases(node: Node) -> list[Phrase]:
    return node.phrases + [p for part in node.parts for p in _phrases(part)]


def _places(phrase: Phrase, column: str) -> Column:
    """Token numbers, from 1, at which the phrase starts in a column."""
    t, n = F.col(f"_t_{column}"), len(phrase.words)

    def at(k: int):
        word = phrase.words[k]
        return lambda x: F.startswith(x, F.lit(word)) if phrase.prefix and k == n - 1 else x == word

    if n == 1:
        found = F.filter(F.transform(t, lambda x, i: F.when(at(0)(x), i + 1)), lambda i: i.isNotNull())
    else:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        found = F.filter(starts, lambda i: reduce(lambda a, b: a & b, [at(k)(F.element_at(t, i + k)) for k in range(n)]))
    return F.filter(found, lambda i: i == 1) if phrase.initial else found


def _back(k: int) -> Callable[[Column], Column]:
    return lambda i: i - k


Places = Callable[[Phrase, str], Column]


def _count(phrase: Phrase, node: Node | None = None, places: Places = _places) -> Column:
    """Occurrences in the phrase's columns; with ``node``, a NEAR group, those close to each of its other phrases."""
    total = F.lit(0)
    for c in phrase.columns:
        if node is None and len(phrase.words) == 1 and not phrase.initial and places is _places:
            word, prefix = phrase.words[0], phrase.prefix
            total = total + F.size(F.filter(F.col(f"_t_{c}"), lambda x: F.startswith(x, F.lit(word)) if prefix else x == word))
            continue
        found = places(phrase, c)
        if node is not None:
            for other in node.phrases:
                if other is not phrase:
                    near, mine, theirs = places(other, c), len(phrase.words), len(other.words)
                    found = F.filter(found, lambda i: F.exists(near, lambda j: F.when(i <= j, j - i - mine).otherwise(i - j - theirs) <= node.distance))
        total = total + F.size(found)
    return total.cast("long")


def _plan(node: Node, counts: list[tuple[Phrase, Node | None]], whole: list[Column]) -> Column:
    """The match of a tree over the count columns ``_n0, _n1, ...``, which it appends to. ``whole`` gets for each phrase
    whether every part of the tree around it matches: only then does it score."""
    first = len(counts)
    out = _match(node, counts, whole)
    whole[first:] = [w & out for w in whole[first:]]
    return out


def _match(node: Node, counts: list[tuple[Phrase, Node | None]], whole: list[Column]) -> Column:
    if node.op in ("phrase", "near"):
        if not node.phrases:
            return F.lit(False)
        out = F.lit(True)
        for p in node.phrases:
            counts.append((p, node if node.op == "near" else None))
            whole.append(F.lit(True))
            out = out & (F.col(f"_n{len(counts) - 1}") > 0)
        return out
    if node.op == "not":
        return _plan(node.parts[0], counts, whole) & ~_plan(node.parts[1], counts, whole)
    parts = [_plan(p, counts, whole) for p in node.parts]
    return reduce(lambda a, b: a & b if node.op == "and" else a | b, parts)


def _negative(node: Node, inside: bool = False) -> list[bool]:
    """Whether each phrase, in the order of ``_plan``, stands on the right of a NOT: it doesn't score."""
    if node.op in ("phrase", "near"):
        return [inside] * len(node.phrases)
    if node.op == "not":
        return _negative(node.parts[0], inside) + _negative(node.parts[1], True)
    return [x for p in node.parts for x in _negative(p, inside)]


def counted(chunks: DataFrame, query: str) -> tuple[DataFrame, Column, dict[int, Column]]:
    """``chunks`` with ``_dl`` and the count of each phrase, the match, and the phrases that score with where they do."""
    tree = parse(query)
    counts: list[tuple[Phrase, Node | None]] = []
    whole: list[Column] = []
    match = _plan(tree, counts, whole)
    base = chunks.select("*", *[tokens(F.col(c)).alias(f"_t_{c}") for c in COLUMNS])
    dl = reduce(lambda a, b: a + b, [F.size(f"_t_{c}") for c in COLUMNS]).cast("long")
    out = base.select(*chunks.columns, dl.alias("_dl"), *[_count(p, n).alias(f"_n{k}") for k, (p, n) in enumerate(counts)])
    return out, match, {k: whole[k] for k, no in enumerate(_negative(tree)) if not no}


def bm25(chunks: DataFrame, query: str, where: Column | None = None) -> DataFrame:
    """``id, score`` of all matching chunks; higher is better. ``where`` filters candidates, not statistics."""
    need = list(dict.fromkeys(["id", *COLUMNS]))
    extra = [c for c in chunks.columns if c not in need]
    rows, match, scoring = counted(chunks.select(*need, *extra), query)
    if not scoring:
        return chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    stats = rows.agg(F.count("*").alias("_n"), (F.sum("_dl") / F.count("*")).alias("_avgdl"), *_frequencies(scoring))
    return _scored(rows.where(match if where is None else match & where), stats, scoring)


def _frequencies(scoring: dict[int, Column]) -> list[Column]:
    return [F.coalesce(F.sum((F.col(f"_n{k}") > 0).cast("long")), F.lit(0)).alias(f"_df{k}") for k in scoring]


def _scored(found: DataFrame, stats: DataFrame, scoring: dict[int, Column]) -> DataFrame:
    """``id, score`` of rows ``id, _dl, _n0 ...``; ``stats`` is one row ``_n, _avgdl, _df...``."""
    rows = found.select("id", "_dl", *[F.when(where, F.col(f"_n{k}")).otherwise(0).alias(f"_n{k}") for k, where in scoring.items()]).crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    for k in scoring:
        raw = F.log((F.col("_n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5))
        idf = F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))
        tf = F.col(f"_n{k}")
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avgdl")))
    return rows.select("id", total.alias("score"))


def bm25_postings(index: DataFrame, stats: DataFrame, query: str, allowed: DataFrame | None = None) -> DataFrame:
    """``bm25`` of a stored index (``postings`` sorted by term, ``stats`` its ``n, avgdl``). Only the rows of the query's terms,
    and of those that begin with its prefixes, are read. ``allowed`` (``id``) filters candidates, not statistics."""
    tree = parse(query)
    counts: list[tuple[Phrase, Node | None]] = []
    whole: list[Column] = []
    match = _plan(tree, counts, whole)
    scoring = {k: whole[k] for k, no in enumerate(_negative(tree)) if not no}
    if not scoring:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    terms: dict[tuple[str, bool], int] = {}
    for p, _ in counts:
        for k, word in enumerate(p.words):
            terms.setdefault((word, p.prefix and k == len(p.words) - 1), len(terms))
    is_term = {key: F.startswith(F.col("term"), F.lit(key[0])) if key[1] else F.col("term") == key[0] for key in terms}
    exact = sorted(word for word, prefix in terms if not prefix)
    any_ = reduce(lambda a, b: a | b, [F.col("term").isin(exact)] * bool(exact) + [c for key, c in is_term.items() if key[1]])

    def places(phrase: Phrase, column: str) -> Column:
        n = len(phrase.words)
        held = [F.col(f"_p{terms[(word, phrase.prefix and k == n - 1)]}_{column}") for k, word in enumerate(phrase.words)]
        found = held[0]
        if n > 1:
            # sets of places, each moved back by its word's number
            found = reduce(F.array_intersect, [F.transform(held[k], _back(k)) for k in range(1, n)], found)
        return F.filter(found, lambda i: i == 1) if phrase.initial else found

    gathered = [F.sort_array(F.flatten(F.collect_list(F.when(c, F.col(column))))).alias(f"_p{terms[key]}_{column}") for key, c in is_term.items() for column in COLUMNS]
    docs = index.where(any_).groupBy("id").agg(F.first("dl").alias("_dl"), *gathered)
    docs = docs.select("id", "_dl", *[_count(p, n, places).alias(f"_n{k}") for k, (p, n) in enumerate(counts)])
    totals = docs.agg(*_frequencies(scoring)).crossJoin(F.broadcast(stats.select(F.col("n").alias("_n"), F.col("avgdl").alias("_avgdl"))))  # one row each
    found = docs.where(match)
    return _scored(found if allowed is None else found.join(allowed.select("id"), "id", "left_semi"), totals, scoring)


def top(scored: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows with their ``rank`` from 1. The cut comes first, so the window sees ``k`` rows."""
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def rank_bm25(scored: DataFrame, k: int) -> DataFrame:
    return top(scored, k, [F.desc("score"), F.asc("id")])
