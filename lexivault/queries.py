"""Every query of the engine over the corpus views, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import catalog, changes, fusion, lexical
from .operators.batch import nearest_batch
from .operators.blocks import BlockIndex, top_query
from .operators.dense import nearest
from .operators.ignores import visible
from .operators.ivf import IvfIndex
from .operators.products import packed, top_products
from .operators.reach import reach
from .plans.search import Filters, Searcher
from .plans.segments import SegmentStore
from .runtime import shared_dir, stored
from .operators.lsi import SvdBackend, SvdModel
from .operators.trigrams import NameIndex
from .sources import corpus
from .sources.layout import Layout
from .sources.walk import DEFAULT_EXCLUDES, EXTENSIONS
from .streaming import files as streaming
from .streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VECTOR = 7
WORDS = "apache license"
FILTERS = Filters(lang="en", kind="medium", path_glob="en/src1*/*")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- SQL that oracles share -------------------------------------------------------------------------------------------

CHUNKS = r"""chunks AS (
  SELECT doc_id AS id, lang || '/' || source || '/' || doc_id || '.txt' AS path, lang AS language, 'corpus' AS project, 1 AS start_line,
    (len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END)::INT AS end_line,
    CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS kind,
    source AS name, lang AS scope, text AS content FROM documents)"""
TOKENS = CHUNKS + r""", tokens AS (
  SELECT id, list_filter(string_split_regex(strip_accents(lower(content)) || ' ' || strip_accents(lower(name)) || ' ' || strip_accents(lower(scope)), '[^\p{L}\p{N}\p{Co}]+'), lambda x: x <> '') AS t FROM chunks),
stats AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM tokens)"""


def _bm25(terms: dict[str, str], match: str, scoring: list[str], where: str = "true", k: int = 100) -> str:
    """``terms``: name to SQL for occurrences in ``t``; ``match`` over the names; ``scoring``: the names that score."""
    cols = ", ".join(f"{sql} AS {n}" for n, sql in terms.items())
    dfs = ", ".join(f"(SELECT count(*) FROM tf WHERE {n} > 0) AS df_{n}" for n in scoring)
    part = lambda n: f"(CASE WHEN ln((n - df_{n} + 0.5) / (df_{n} + 0.5)) > 0 THEN ln((n - df_{n} + 0.5) / (df_{n} + 0.5)) ELSE 1e-6::DOUBLE END) * {n} * 2.2::DOUBLE / ({n} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
    return f"""{TOKENS}, tf AS (SELECT id, len(t) AS dl, {cols} FROM tokens),
df AS (SELECT {dfs}),
scored AS (SELECT tf.id, {' + '.join(part(n) for n in scoring)} AS score FROM tf, stats, df, chunks c WHERE c.id = tf.id AND ({match}) AND ({where})),
bm AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= {k})"""


def _occurs(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


TWO = {"w0": _occurs("apache"), "w1": _occurs("license")}
BM = _bm25(TWO, "w0 > 0 AND w1 > 0", ["w0", "w1"])
DENSE = f"""q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {VECTOR}),
near AS (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], v) AS distance, row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], v), vec_id) AS rank
  FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM documents) QUALIFY rank <= 100)"""
FUSED = """fused AS (SELECT coalesce(bm.id, near.id) AS id, coalesce(1 / (60 + bm.rank), 0) + coalesce(1 / (60 + near.rank), 0) AS score, bm.rank AS bm25_rank, near.rank AS dense_rank
  FROM bm FULL OUTER JOIN near ON bm.id = near.id),
best AS (SELECT * FROM fused ORDER BY score DESC, dense_rank ASC NULLS LAST, id LIMIT 20)"""
HITS = """SELECT c.path, c.start_line, c.end_line, c.language, c.kind, c.name, c.scope, array_to_string(string_split(rtrim(c.content, chr(10)), chr(10))[1:30], chr(10)) AS excerpt, round(b.score, 6) AS score"""
FILTER_SQL = "c.language = 'en' AND c.kind = 'medium' AND c.path GLOB 'en/src1*/*'"
SYMBOLS = r"""rows AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS row FROM documents),
words AS (SELECT doc_id, pos, generate_subscripts(m, 1) - 1 AS k, unnest(m) AS name FROM (SELECT *, regexp_extract_all(row, '(?:^| )([A-Z][A-Za-z]+)', 1) AS m FROM rows)),
symbols AS (SELECT doc_id AS chunk_id, name, CASE WHEN k = 0 THEN 'def' ELSE 'ref' END AS kind, (pos + 1)::INT AS line FROM words)"""
EDGES = r"""edges AS (SELECT page_id AS src_chunk_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst_name, 'import' AS kind FROM pages),
page_chunks AS (SELECT page_id AS id, url AS path, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, 1 AS start_line, regexp_extract(url, '://([^/?#]*)', 1) AS scope FROM pages)"""
FILES = CHUNKS + """, base AS (SELECT id, path, id * 1.5::DOUBLE AS mtime, length(content)::BIGINT AS size FROM chunks),
old AS (SELECT path, mtime, size FROM base WHERE id % 10 <> 0),
new AS (SELECT path, mtime, size + CASE WHEN id % 10 = 2 THEN 1 ELSE 0 END AS size FROM base WHERE id % 10 <> 1)"""


#: An index's tables of this session, by application, folder and name, and what they are sorted by.
_INDEXED: dict[tuple[str, str, str], DataFrame] = {}
_SORTED = {"chunks": "id", "chunk_heads": "id", "vectors": "chunk_id", "symbols": "name", "edges": "dst_name", "page_chunks": "path"}


def indexed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``corpus`` as an index has it: in the shared folder and sorted, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _INDEXED:
        by = _SORTED[name]
        _INDEXED[key] = stored(getattr(corpus, name)(spark, sf_dir).repartitionByRange(by).sortWithinPartitions(by), f"index-{name}")
    return _INDEXED[key]


#: Stored indexes of this session: application and folder to tables.
_INDEXES: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame]] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``chunks``, ``postings`` and ``stats`` of a corpus in the shared folder, built once a session as an index is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        chunks = indexed(spark, sf_dir, "chunks")
        places = stored(lexical.postings(chunks), "index-postings")
        _INDEXES[key] = chunks, places, stored(lexical.corpus_stats(chunks), "index-stats")
    return _INDEXES[key]


_BLOCKS: dict[tuple[str, str], BlockIndex] = {}


def stored_blocks(spark: SparkSession, sf_dir: str) -> BlockIndex:
    """The corpus's postings in blocks, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BLOCKS:
        _BLOCKS[key] = BlockIndex.build(corpus.chunks(spark, sf_dir), "index-blocks")
    return _BLOCKS[key]


_PACKS: dict[tuple[str, str], DataFrame] = {}


def stored_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's postings in packs, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PACKS:
        _PACKS[key] = stored(packed(corpus.chunks(spark, sf_dir)), "index-packs")
    return _PACKS[key]


def _searcher(spark: SparkSession, sf_dir: str, words: bool = True) -> Searcher:
    """Over the stored index; searches that don't look for ``words`` need no postings."""
    chunks, places, stats = stored_index(spark, sf_dir) if words else (indexed(spark, sf_dir, "chunks"), None, None)
    vectors = indexed(spark, sf_dir, "vectors")
    return Searcher(chunks, vectors, lambda _: list(vectors.where(F.col("chunk_id") == VECTOR).select("embedding").first()[0]), places, stats)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- search -----------------------------------------------------------------------------------------------------------


@query("search_bm25", f"WITH {BM} {HITS.replace('b.score', '1 / (60 + b.rank)')} FROM bm b JOIN chunks c ON c.id = b.id WHERE b.rank <= 20")
def search_bm25(spark, d):
    return _rounded(_searcher(spark, d).search(WORDS, mode="bm25"), "score")


@query("search_dense", f"WITH {CHUNKS}, {DENSE} {HITS.replace('b.score', '1 / (60 + b.rank)')} FROM near b JOIN chunks c ON c.id = b.id WHERE b.rank <= 20")
def search_dense(spark, d):
    return _rounded(_searcher(spark, d, words=False).search(WORDS, mode="dense"), "score")


@query("search_hybrid", f"WITH {BM}, {DENSE}, {FUSED} {HITS} FROM best b JOIN chunks c ON c.id = b.id")
def search_hybrid(spark, d):
    return _rounded(_searcher(spark, d).search(WORDS), "score")


@query("search_hybrid_ties", f"WITH {BM}, {DENSE}, {FUSED} SELECT id, round(score, 6) AS score, bm25_rank, dense_rank, row_number() OVER (ORDER BY score DESC, dense_rank ASC NULLS LAST, id) AS place FROM fused")
def search_hybrid_ties(spark, d):
    found = _searcher(spark, d).candidates(WORDS)
    # two hundred rows at most
    return _rounded(found.withColumn("place", F.row_number().over(Window.orderBy(*fusion.fused_order())).cast("long")), "score")


@query("search_hydrate", f"WITH {BM}, {DENSE}, {FUSED} {HITS}, c.id, b.bm25_rank, b.dense_rank FROM best b JOIN chunks c ON c.id = b.id")
def search_hydrate(spark, d):
    return _rounded(_searcher(spark, d).search(WORDS, explain=True), "score")


_FILTERED = f"""WITH {_bm25(TWO, "w0 > 0 AND w1 > 0", ["w0", "w1"], FILTER_SQL)}, {DENSE.replace("WHERE vec_id IN (SELECT doc_id FROM documents)", f"WHERE vec_id IN (SELECT id FROM chunks c WHERE {FILTER_SQL})")}, {FUSED} {HITS} FROM best b JOIN chunks c ON c.id = b.id"""


@query("search_filters_all", _FILTERED)
def search_filters_all(spark, d):
    return _rounded(_searcher(spark, d).search(WORDS, filters=FILTERS), "score")


@query("search_filters_post", f"WITH {BM}, {DENSE} SELECT n.id, round(1 / (60 + row_number() OVER (ORDER BY n.distance, n.id)), 6) AS score FROM near n JOIN chunks c ON c.id = n.id WHERE c.language = 'en'")
def search_filters_post(spark, d):
    return _rounded(_searcher(spark, d, words=False).candidates(WORDS, mode="dense", filters=Filters(lang="en"), dense_filter="post").select("id", "score"), "score")


@query("search_pool_cap", f"WITH {_bm25(TWO, 'w0 > 0 AND w1 > 0', ['w0', 'w1'], k=5)} SELECT id, round(1 / (60 + rank), 6) AS score FROM bm")
def search_pool_cap(spark, d):
    return _rounded(_searcher(spark, d).candidates(WORDS, mode="bm25", bm25_k=5).select("id", "score"), "score")


@query("search_zero", "SELECT doc_id AS id, 0.0::DOUBLE AS score FROM documents WHERE false")
def search_zero(spark, d):
    return _searcher(spark, d).candidates("zzzznothingzzzz", mode="bm25").select("id", "score")


def _mode(name: str, words: str, sql: str) -> None:
    @query(name, f"WITH {sql} SELECT id, round(score, 6) AS score FROM scored")
    def run(spark, d):
        _, places, stats = stored_index(spark, d)
        return _rounded(lexical.bm25_postings(places, stats, words), "score")


_mode("search_mode_and", "apache AND license", _bm25(TWO, "w0 > 0 AND w1 > 0", ["w0", "w1"]))
_mode("search_mode_or", "apache OR reserved", _bm25({"w0": _occurs("apache"), "w1": _occurs("reserved")}, "w0 > 0 OR w1 > 0", ["w0", "w1"]))
_mode("search_mode_not", "license NOT apache", _bm25({"w0": _occurs("license"), "w1": _occurs("apache")}, "w0 > 0 AND NOT w1 > 0", ["w0"]))
_mode("search_mode_prefix", "licen*", _bm25({"w0": "len(list_filter(t, lambda x: starts_with(x, 'licen')))"}, "w0 > 0", ["w0"]))
_mode("search_mode_phrase", '"general public license"', _bm25({"w0": "len(list_filter(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] = 'general' AND t[i + 1] = 'public' AND t[i + 2] = 'license'))"}, "w0 > 0", ["w0"]))
_mode("search_mode_near", "NEAR(general license, 1)", _bm25({"w0": "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'general' AND len(list_filter(range(greatest(i - 2, 1), least(i + 3, len(t) + 1)), lambda j: t[j] = 'license')) > 0))", "w1": "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'license' AND len(list_filter(range(greatest(i - 2, 1), least(i + 3, len(t) + 1)), lambda j: t[j] = 'general')) > 0))"}, "w0 > 0 AND w1 > 0", ["w0", "w1"]))
_mode("search_mode_initial", "^the", _bm25({"w0": "CASE WHEN t[1] = 'the' THEN 1 ELSE 0 END"}, "w0 > 0", ["w0"]))
_mode("search_mode_common", "the", _bm25({"w0": _occurs("the")}, "w0 > 0", ["w0"]))
_mode("search_mode_column", "name:src3 license", _bm25({"w0": f"{_occurs('src3')} * CASE WHEN (SELECT name FROM chunks c2 WHERE c2.id = tokens.id) = 'src3' THEN 1 ELSE 0 END", "w1": _occurs("license")}, "w0 > 0 AND w1 > 0", ["w0", "w1"]))


@query("rank_bm25", f"WITH {BM} SELECT id, round(score, 6) AS score, rank FROM bm")
def rank_bm25(spark, d):
    return _rounded(lexical.rank_bm25(lexical.bm25(corpus.chunks(spark, d), WORDS), 100), "score")


@query("rank_dense", f"WITH {DENSE.replace('WHERE vec_id IN (SELECT doc_id FROM documents) ', '')} SELECT id, round(distance, 6) AS distance, rank FROM near")
def rank_dense(spark, d):
    return _rounded(nearest(corpus.vectors(spark, d), corpus.query_vector(spark, d, VECTOR), 100), "distance")


@query("rank_dense_cosine", f"SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {VECTOR})), 6) AS distance FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {VECTOR})) DESC, vec_id LIMIT 50")
def rank_dense_cosine(spark, d):
    return _rounded(nearest(corpus.vectors(spark, d), corpus.query_vector(spark, d, VECTOR), 50, "cosine").drop("rank"), "distance")


@query("bm25_corpus_stats", f"WITH {TOKENS} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def bm25_corpus_stats(spark, d):
    return _rounded(lexical.corpus_stats(corpus.chunks(spark, d)), "avgdl")


@query("bm25_term_stats", f"WITH {TOKENS}, w AS (SELECT id, unnest(t) AS term FROM tokens) SELECT term, count(DISTINCT id) AS docs, count(*)::BIGINT AS occurrences FROM w GROUP BY term")
def bm25_term_stats(spark, d):
    return lexical.term_stats(corpus.chunks(spark, d))


@query("tok_vocab", r"WITH w AS (SELECT doc_id, unnest(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}\p{Co}]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM w WHERE term <> '' GROUP BY term")
def tok_vocab(spark, d):
    words = corpus.table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    per = words.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("occurrences"))


# --- many queries at once, and the best rows without reading all postings -----------------------------------------------

#: Rows to a query, and the rows that are queries: those whose id is divisible by it.
BATCH_K, BATCH_OF = 10, 100
_SPOKEN = r"list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}\p{Co}]+'), lambda x: x <> '')"
_IDF = "(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6::DOUBLE END)"


def _top_sql(asked: str, k: int, every: bool = False, tokens: str = TOKENS) -> str:
    """``asked``: ``query, term``."""
    held = "HAVING count(*) = (SELECT count(*) FROM asked)" if every else ""
    return f"""WITH {tokens}, asked AS ({asked}), w AS (SELECT id, unnest(t) AS term FROM tokens), tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), dl AS (SELECT id, len(t) AS dl FROM tokens),
s AS (SELECT query, tf.id, sum(round(1e12 * {_IDF} * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))::BIGINT) / 1e12 AS score FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.id = tf.id, stats GROUP BY query, tf.id {held})
SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= {k}"""


@query("search_bm25_batch", _top_sql(f"SELECT DISTINCT query, term FROM (SELECT doc_id AS query, unnest({_SPOKEN}) AS term FROM documents WHERE doc_id % {BATCH_OF} = 0)", BATCH_K))
def search_bm25_batch(spark, d):
    asked = corpus.table(spark, d, "documents").where(F.col("doc_id") % BATCH_OF == 0)
    words = asked.select(F.col("doc_id").alias("query"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return _rounded(top_products(stored_packs(spark, d), words, BATCH_K), "score")


@query("search_dense_batch", f"SELECT q.vec_id AS query, v.vec_id AS id, round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % {BATCH_OF} = 0 QUALIFY rank <= {BATCH_K}")
def search_dense_batch(spark, d):
    vectors = corpus.vectors(spark, d)
    asked = vectors.where(F.col("chunk_id") % BATCH_OF == 0).select(F.col("chunk_id").alias("query"), "embedding")
    return _rounded(nearest_batch(vectors, asked, BATCH_K), "distance")


_DENSE: dict[tuple[str, str], IvfIndex] = {}


def dense_index(spark: SparkSession, sf_dir: str) -> IvfIndex:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DENSE:
        _DENSE[key] = IvfIndex.build(corpus.vectors(spark, sf_dir))
    return _DENSE[key]


@query("search_dense_index", ORACLES["search_dense_batch"])
def search_dense_index(spark, d):
    asked = corpus.vectors(spark, d).where(F.col("chunk_id") % BATCH_OF == 0).select(F.col("chunk_id").alias("query"), "embedding")
    return _rounded(dense_index(spark, d).search(asked, BATCH_K, exact=True), "distance")


@query("embed_svd", f"SELECT doc_id AS id, 32 AS dim, CASE WHEN len(list_filter(string_split_regex(strip_accents(lower(text[1:{T.CHAR_CAP}])), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '')) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def embed_svd(spark, d):
    """Vectors of a model that is learned from the corpus: SQL can say their lengths only."""
    docs = corpus.chunks(spark, d)
    backend = SvdBackend(SvdModel.fit(docs, dim=32, passes=2))
    squares = F.aggregate(F.transform(F.col("v").cast("array<double>"), lambda x: x * x), F.lit(0.0), lambda a, b: a + b)
    return docs.select("id", backend.column(F.col("content"), 64).alias("v")).select("id", F.size("v").alias("dim"), F.round(F.sqrt(squares), 3).alias("norm"))


def _top(name: str, words: str, every: bool = False) -> None:
    asked = "SELECT 0 AS query, unnest([" + ", ".join(f"'{w}'" for w in words.lower().replace(" or ", " ").replace(" and ", " ").split()) + "]) AS term"

    @query(name, f"SELECT id, score, rank FROM ({_top_sql(asked, 20, every)})")
    def run(spark, d):
        searcher = Searcher(corpus.chunks(spark, d), blocks=stored_blocks(spark, d))
        return _rounded(searcher.lexical_pool(words, 20, Filters()).select("id", "score", "rank"), "score")


_top("search_top_common", "the")
_top("search_top_or", "apache OR license OR reserved")
_top("search_top_and", "apache AND license", True)


# --- an index kept current by segments ----------------------------------------------------------------------------------

#: Chunks of documents after two changes, which give new ids: of ten documents one comes, one grows, one goes; then of
#: twenty one that had grown goes too, and of thirty one is replaced again.
_STATE = """state AS (
  SELECT doc_id AS id, doc_id, text FROM documents WHERE doc_id % 10 NOT IN (0, 1, 2) AND doc_id % 30 <> 5
  UNION ALL SELECT doc_id + 1000000, doc_id, text FROM documents WHERE doc_id % 10 = 0
  UNION ALL SELECT doc_id + 1000000, doc_id, text || ' apache license' FROM documents WHERE doc_id % 10 = 2 AND doc_id % 20 <> 2
  UNION ALL SELECT doc_id + 2000000, doc_id, 'license ' || text FROM documents WHERE doc_id % 30 = 5),
tokens AS (SELECT id, list_filter(string_split_regex(strip_accents(lower(text)) || ' ' || strip_accents(lower(source)) || ' ' || strip_accents(lower(lang)), '[^\\p{L}\\p{N}\\p{Co}]+'), lambda x: x <> '') AS t FROM state JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id)),
stats AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM tokens)"""
_SEGMENTS: dict[tuple[str, str], SegmentStore] = {}


def segment_store(spark: SparkSession, sf_dir: str) -> SegmentStore:
    """An index of the corpus after those changes and merges, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SEGMENTS:
        store = SegmentStore(spark, f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}")
        docs = corpus.chunks(spark, sf_dir).select("id", F.concat(F.lit("d"), F.col("id").cast("string")).alias("path"), "name", "scope", "content")
        of = lambda ten, by=10: F.col("id") % by == ten
        store.change(docs.where(~of(0)))
        grown = docs.where(of(2)).withColumn("content", F.concat("content", F.lit(" apache license")))
        store.change(docs.where(of(0)).unionAll(grown).withColumn("id", F.col("id") + 1_000_000), docs.where(of(1)).select("path"))
        again = docs.where(of(5, 30)).select((F.col("id") + 2_000_000).alias("id"), "path", "name", "scope", F.concat(F.lit("license "), "content").alias("content"))
        store.change(again, docs.where(of(2, 20)).select("path"))
        store.compact()
        _SEGMENTS[key] = store
    return _SEGMENTS[key]


@query("segments_live", f"WITH {_STATE} SELECT id, md5(text) AS digest, len(t)::BIGINT AS tokens FROM state JOIN tokens USING (id)")
def segments_live(spark, d):
    return segment_store(spark, d).chunks().select("id", F.md5(F.col("content").cast("binary")).alias("digest"), F.col("dl").alias("tokens"))


@query("segments_terms", f"WITH {_STATE} SELECT term, count(DISTINCT id) AS docs FROM (SELECT id, unnest(t) AS term FROM tokens) GROUP BY term")
def segments_terms(spark, d):
    return segment_store(spark, d).index().dictionary.select("term", "docs")


@query("segments_stats", f"WITH {_STATE} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def segments_stats(spark, d):
    return _rounded(segment_store(spark, d).index().stats, "avgdl")


def _over_segments(name: str, words: list[str], every: bool) -> None:
    asked = "SELECT 0 AS query, unnest([" + ", ".join(f"'{w}'" for w in words) + "]) AS term"

    @query(name, f"SELECT id, score, rank FROM ({_top_sql(asked, 20, every, _STATE)})")
    def run(spark, d):
        return _rounded(top_query(segment_store(spark, d).index(), words, 20, every), "score")


_over_segments("segments_search_or", ["apache", "license"], False)
_over_segments("segments_search_and", ["the", "license"], True)


# --- filters and projections ------------------------------------------------------------------------------------------

_PATHS = "SELECT c.id FROM chunks c WHERE "


@query("flt_language", f"WITH {CHUNKS} {_PATHS} language = 'de'")
def flt_language(spark, d):
    return corpus.chunks(spark, d).where(Filters(lang="de").condition()).select("id")


@query("flt_kind", f"WITH {CHUNKS} {_PATHS} kind = 'long'")
def flt_kind(spark, d):
    return corpus.chunks(spark, d).where(Filters(kind="long").condition()).select("id")


@query("flt_path_glob", f"WITH {CHUNKS} {_PATHS} path GLOB '*/src[1-3]/*[13].t?t'")
def flt_path_glob(spark, d):
    return corpus.chunks(spark, d).where(T.glob(F.col("path"), "*/src[1-3]/*[13].t?t")).select("id")


@query("flt_extension", "SELECT page_id, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '[^/](\\.[^./]+)$', 1)) AS extension FROM pages WHERE lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '[^/](\\.[^./]+)$', 1)) IN ('.html', '.htm')")
def flt_extension(spark, d):
    path = F.regexp_replace("url", "[?#].*$", "")
    return corpus.table(spark, d, "pages").select("page_id", T.extension(path).alias("extension")).where(F.col("extension").isin(".html", ".htm"))


@query("flt_size_cap", "SELECT doc_id FROM documents WHERE octet_length(encode(text)) <= 4096")
def flt_size_cap(spark, d):
    return corpus.table(spark, d, "documents").where(F.octet_length("text") <= 4096).select("doc_id")


@query("flt_binary_probe", "SELECT doc_id FROM documents WHERE NOT contains(CASE WHEN doc_id % 7 = 0 THEN 'x' || repeat('y', doc_id) || '|' ELSE text END[1:8192], '|')")
def flt_binary_probe(spark, d):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), F.repeat(F.lit("y"), F.col("doc_id").cast("int")), F.lit("|"))).otherwise(F.col("text"))
    content = F.encode(F.replace(F.substring(text, 1, 8192), F.lit("|"), F.lit("\0")), "UTF-8")
    return corpus.table(spark, d, "documents").where(~T.is_binary(content)).select("doc_id")


_WALKED = "CASE doc_id % 6 WHEN 0 THEN 'src/a/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN 'lib/build/' WHEN 3 THEN 'docs/.helpers/' WHEN 4 THEN 'pkg.egg-info/' ELSE 'docs/guide/' END || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.min.js' ELSE '.py' END"


def _walked(spark: SparkSession, d: str) -> DataFrame:
    part = F.expr("CASE doc_id % 6 WHEN 0 THEN 'src/a/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN 'lib/build/' WHEN 3 THEN 'docs/.helpers/' WHEN 4 THEN 'pkg.egg-info/' ELSE 'docs/guide/' END")
    end = F.when(F.col("doc_id") % 4 == 0, ".min.js").otherwise(".py")
    return corpus.table(spark, d, "documents").select("doc_id", F.concat(part, F.col("doc_id").cast("string"), end).alias("path"))


@query("flt_default_excludes", f"SELECT doc_id, {_WALKED} AS path FROM documents WHERE doc_id % 6 IN (0, 5)")
def flt_default_excludes(spark, d):
    return _walked(spark, d).where(~T.ignored(F.col("path"), DEFAULT_EXCLUDES))


@query("flt_ignores", f"SELECT doc_id, {_WALKED} AS path FROM documents WHERE NOT (doc_id % 4 = 0 OR doc_id % 6 = 5 OR doc_id % 6 = 2)")
def flt_ignores(spark, d):
    return _walked(spark, d).where(~T.ignored(F.col("path"), ["*.min.js", "/docs/guide", "lib/**/", "# a comment", ""]))


#: Ignore files of a tree made of the documents: folder, line.
_IGNORES = (("", "*.log"), ("", "!*5.log"), ("", "/src4"), ("src1", "*.py"), ("src1", "!*7.py"), ("src1/de", "*7.py"), ("src2", "fr/"), ("src3/en", "# a comment"), ("src3/en", ""), ("src3/en", "src1?/"))
_TREE = "'src' || doc_id % 5 || '/' || lang || '/' || source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.log' ELSE '.py' END"


@query("flt_nested_ignores", f"""SELECT doc_id, path FROM (SELECT doc_id, {_TREE} AS path FROM documents) WHERE NOT (path LIKE '%.log' AND path NOT LIKE '%5.log' OR path LIKE 'src4/%'
  OR path LIKE 'src1/%.py' AND path NOT LIKE '%7.py' OR path LIKE 'src1/de/%7.py' OR path LIKE 'src2/fr/%' OR regexp_matches(path, '^src2/.*/fr/') OR regexp_matches(path, '^src3/en/src1[^/]/'))""")
def flt_nested_ignores(spark, d):
    paths = corpus.table(spark, d, "documents").select("doc_id", F.expr(_TREE).alias("path"))
    return visible(paths, spark.createDataFrame([(f, n, line) for n, (f, line) in enumerate(_IGNORES)], "folder string, place int, line string"))


@query("prj_excerpt", "SELECT doc_id, array_to_string(string_split(rtrim(text, chr(10)), chr(10))[1:30], chr(10)) AS excerpt FROM documents")
def prj_excerpt(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("prj_line_slice", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) || CASE WHEN len(string_split(text, chr(10))) > 3 THEN chr(10) ELSE '' END AS lines FROM documents")
def prj_line_slice(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", T.line_slice(F.col("text"), F.lit(2), F.lit(3)).alias("lines"))


@query("prj_char_cap", f"SELECT doc_id, text[1:{T.CHAR_CAP}] AS text, length(text[1:{T.CHAR_CAP}])::BIGINT AS n FROM documents")
def prj_char_cap(spark, d):
    cut = F.substring("text", 1, T.CHAR_CAP)
    return corpus.table(spark, d, "documents").select("doc_id", cut.alias("text"), F.length(cut).cast("long").alias("n"))


@query("prj_scope_suffix", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN source END ELSE coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, '') || '|fsproj=' || doc_id % 3 END AS scope FROM documents")
def prj_scope_suffix(spark, d):
    scope = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    order = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3)
    return corpus.table(spark, d, "documents").select("doc_id", T.scope_suffix(scope, order).alias("scope"))


@query("src_parquet", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents")
def src_parquet(spark, d):
    return corpus.table(spark, d, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# --- symbols and graph ------------------------------------------------------------------------------------------------


def _symbol_sql(where: str) -> str:
    return f"WITH {CHUNKS}, {SYMBOLS} SELECT c.path, c.scope, c.language, s.name, s.line FROM symbols s JOIN chunks c ON c.id = s.chunk_id WHERE {where}"


def _symbols(spark, d, *args, **more):
    return catalog.symbols(indexed(spark, d, "symbols"), indexed(spark, d, "chunk_heads"), *args, **more)


@query("sym_defs_substr", _symbol_sql("s.kind = 'def' AND s.name LIKE '%Lic%'"))
def sym_defs_substr(spark, d):
    return _symbols(spark, d, "Lic")


@query("sym_defs_exact", _symbol_sql("s.kind = 'def' AND s.name = 'The'"))
def sym_defs_exact(spark, d):
    return _symbols(spark, d, "The", exact=True)


@query("sym_defs_wild", _symbol_sql("s.kind = 'def' AND s.name LIKE '%T_e%'"))
def sym_defs_wild(spark, d):
    return _symbols(spark, d, "T_e")


@query("sym_refs", _symbol_sql("s.kind = 'ref' AND s.name LIKE '%Of%'"))
def sym_refs(spark, d):
    return _symbols(spark, d, "Of", kind="ref")


@query("sym_lang", _symbol_sql("s.kind = 'def' AND s.name LIKE '%De%' AND c.language = 'de'"))
def sym_lang(spark, d):
    return _symbols(spark, d, "De", language="de")


def _edge_sql(where: str) -> str:
    return f"WITH {EDGES} SELECT c.path, c.scope, c.language, c.start_line, e.kind, e.dst_name FROM edges e JOIN page_chunks c ON c.id = e.src_chunk_id WHERE {where}"


def _callers(spark, d, *args, **more):
    return catalog.callers(indexed(spark, d, "edges"), indexed(spark, d, "page_chunks"), *args, **more)


@query("graph_callers_substr", _edge_sql("e.dst_name LIKE '%the%'"))
def graph_callers_substr(spark, d):
    return _callers(spark, d, "the")


@query("graph_callers_exact", _edge_sql("e.dst_name = '/the'"))
def graph_callers_exact(spark, d):
    return _callers(spark, d, "/the", exact=True)


@query("graph_callers_lang", _edge_sql("e.dst_name LIKE '%de%' AND c.language = 'fr'"))
def graph_callers_lang(spark, d):
    return _callers(spark, d, "de", language="fr")


_DEPS = f"WITH {EDGES} SELECT c.path, e.kind, e.dst_name, NULL::VARCHAR AS meta FROM edges e JOIN page_chunks c ON c.id = e.src_chunk_id WHERE c.path = (SELECT url FROM pages WHERE page_id = 5)"


def _fifth(spark, d) -> str:
    return corpus.table(spark, d, "pages").where("page_id = 5").select("url").first()[0]


@query("graph_deps", _DEPS)
def graph_deps(spark, d):
    return catalog.deps(indexed(spark, d, "edges"), indexed(spark, d, "page_chunks"), _fifth(spark, d))


@query("graph_deps_lang", _DEPS + " AND c.language = 'en'")
def graph_deps_lang(spark, d):
    return catalog.deps(indexed(spark, d, "edges"), indexed(spark, d, "page_chunks"), _fifth(spark, d), language="en")


def _slashed(spark, d) -> DataFrame:
    return indexed(spark, d, "symbols").withColumn("name", F.concat(F.lit("/"), "name"))


@query("graph_unresolved", f"WITH {EDGES}, {SYMBOLS} SELECT src_chunk_id, dst_name, kind FROM edges WHERE dst_name NOT IN (SELECT '/' || name FROM symbols WHERE kind = 'def')")
def graph_unresolved(spark, d):
    return catalog.unresolved(indexed(spark, d, "edges"), _slashed(spark, d))


@query("graph_resolved", f"WITH {EDGES}, {SYMBOLS} SELECT c.path, c.scope, c.language, c.start_line, e.kind, e.dst_name, e.dst_name IN (SELECT '/' || name FROM symbols WHERE kind = 'def') AS resolved FROM edges e JOIN page_chunks c ON c.id = e.src_chunk_id WHERE e.dst_name LIKE '%The%'")
def graph_resolved(spark, d):
    return _callers(spark, d, "The", resolve=_slashed(spark, d))


_LINKS = f"{EDGES}, links AS (SELECT DISTINCT c.scope AS src, e.dst_name AS dst FROM edges e JOIN page_chunks c ON c.id = e.src_chunk_id UNION SELECT DISTINCT e.dst_name, c.scope FROM edges e JOIN page_chunks c ON c.id = e.src_chunk_id)"


_NAMES: dict[tuple[str, str, str], NameIndex] = {}


def name_index(spark: SparkSession, sf_dir: str, kind: str) -> NameIndex:
    """Over symbols' names or edges' targets, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _NAMES:
        _NAMES[key] = NameIndex.of(indexed(spark, sf_dir, "symbols")) if kind == "symbols" else NameIndex.of(indexed(spark, sf_dir, "edges"), "dst_name")
    return _NAMES[key]


def _by_names(name: str, pattern: str, kind: str = "def") -> None:
    @query(name, _symbol_sql(f"s.kind = '{kind}' AND s.name LIKE '%{pattern}%'"))
    def run(spark, d):
        return _symbols(spark, d, pattern, kind=kind, names=name_index(spark, d, "symbols"))


_by_names("sym_names_substr", "tion")
_by_names("sym_names_wild", "the_e%an", "ref")
_by_names("sym_names_short", "Of", "ref")


@query("graph_names_substr", _edge_sql("e.dst_name LIKE '%the%'"))
def graph_names_substr(spark, d):
    return catalog.callers(indexed(spark, d, "edges"), indexed(spark, d, "page_chunks"), "the", names=name_index(spark, d, "edges"))


#: A directed graph with many cycles: each line's part leads to that of the next line of its order.
_NEXT = "links AS (SELECT DISTINCT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem)"


@query("graph_closure", f"WITH RECURSIVE {_NEXT}, walk AS (SELECT DISTINCT src AS source, src AS node FROM links WHERE src % {BATCH_OF} = 0 UNION SELECT w.source, l.dst FROM walk w JOIN links l ON l.src = w.node WHERE l.dst IS NOT NULL) SELECT source, node FROM walk")
def graph_closure(spark, d):
    lines = corpus.table(spark, d, "lineitem")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    links = lines.select(F.col("l_partkey").alias("src"), following.alias("dst"))
    return reach(links, links.where(F.col("src") % BATCH_OF == 0).select(F.col("src").alias("node")))


@query("graph_depth2", f"WITH RECURSIVE {_LINKS}, walk AS (SELECT (SELECT min(scope) FROM page_chunks) AS node, 0 AS depth UNION SELECT l.dst, w.depth + 1 FROM walk w JOIN links l ON l.src = w.node WHERE w.depth < 2) SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node")
def graph_depth2(spark, d):
    pages = indexed(spark, d, "page_chunks")
    out = indexed(spark, d, "edges").join(pages.select(F.col("id").alias("src_chunk_id"), "scope"), "src_chunk_id").select(F.col("scope").alias("src"), F.col("dst_name").alias("dst"))
    links = out.union(out.select("dst", "src")).distinct()
    return catalog.reachable(links, pages.agg(F.min("scope").alias("node")), 2)


# --- sync -------------------------------------------------------------------------------------------------------------

_STATUS = f"""WITH {FILES}, status AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
  WHEN o.mtime = n.mtime AND o.size = n.size THEN 'unchanged' ELSE 'changed' END AS status FROM old o FULL OUTER JOIN new n ON o.path = n.path)"""


@query("sync_classify", f"{_STATUS} SELECT path, status FROM status")
def sync_classify(spark, d):
    return changes.classify(*corpus.files(spark, d))


@query("agg_sync_counts", f"{_STATUS} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'removed') AS removed FROM status")
def agg_sync_counts(spark, d):
    return changes.counts(changes.classify(*corpus.files(spark, d)))


@query("sync_removed", f"WITH {FILES} SELECT path FROM old EXCEPT SELECT path FROM new")
def sync_removed(spark, d):
    return changes.removed(*corpus.files(spark, d))


@query("sync_known", f"WITH {FILES} SELECT path FROM old INTERSECT SELECT path FROM new")
def sync_known(spark, d):
    return changes.still_known(*corpus.files(spark, d))


@query("sync_delete_semi", f"{_STATUS} SELECT id, path FROM chunks WHERE path IN (SELECT path FROM status WHERE status IN ('removed', 'changed'))")
def sync_delete_semi(spark, d):
    gone = changes.classify(*corpus.files(spark, d)).where("status IN ('removed', 'changed')")
    return changes.victims(corpus.chunks(spark, d), gone).select("id", "path")


@query("sync_survivors_anti", f"{_STATUS} SELECT id, path FROM chunks WHERE path NOT IN (SELECT path FROM status WHERE status IN ('removed', 'changed'))")
def sync_survivors_anti(spark, d):
    gone = changes.classify(*corpus.files(spark, d)).where("status IN ('removed', 'changed')")
    return changes.survivors(corpus.chunks(spark, d), gone).select("id", "path")


@query("sink_files_upsert", f"WITH {FILES} SELECT path, mtime, size FROM new UNION ALL SELECT path, mtime, size FROM old WHERE path NOT IN (SELECT path FROM new)")
def sink_files_upsert(spark, d):
    return changes.upsert_files(*corpus.files(spark, d))


@query("sync_apply", f"""{_STATUS}, fresh AS (SELECT path, row_number() OVER (ORDER BY path) + 1000000 - 1 AS id FROM chunks WHERE path IN (SELECT path FROM status WHERE status IN ('added', 'changed')))
SELECT id, path FROM fresh UNION ALL SELECT id, path FROM chunks WHERE path IN (SELECT path FROM status WHERE status = 'unchanged')""")
def sync_apply(spark, d):
    status = changes.classify(*corpus.files(spark, d))
    rows = corpus.chunks(spark, d).select("id", "path", "start_line", "end_line")
    new = rows.join(status.where("status IN ('added', 'changed')").select("path"), "path", "left_semi").drop("id")
    return changes.apply(rows, status.where("status <> 'unchanged'"), new, 1_000_000).select("id", "path")


# --- aggregates, ids and joins ----------------------------------------------------------------------------------------


@query("agg_count", "SELECT count(*) AS n, count(*) = 0 AS empty FROM documents")
def agg_count(spark, d):
    return corpus.chunks(spark, d).agg(F.count("*").alias("n")).withColumn("empty", F.col("n") == 0)


@query("agg_build_counts", f"WITH {CHUNKS}, {SYMBOLS}, {EDGES} SELECT (SELECT count(DISTINCT path) FROM chunks) AS files, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges")
def agg_build_counts(spark, d):
    one = lambda df, name, c="*": df.agg((F.count("*") if c == "*" else F.count_distinct(c)).alias(name))
    rows = corpus.chunks(spark, d).agg(F.count_distinct("path").alias("files"), F.count("*").alias("chunks"))
    return rows.crossJoin(one(corpus.symbols(spark, d), "symbols")).crossJoin(one(corpus.edges(spark, d), "edges"))  # rows of one


@query("agg_first_chunk", "SELECT split_part(url, '/', 3) AS path, min(page_id) AS chunk_id FROM pages GROUP BY 1")
def agg_first_chunk(spark, d):
    return changes.first_chunk(corpus.table(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("path"), F.col("page_id").alias("id")))


@query("agg_rollup_lang_kind", f"WITH {CHUNKS} SELECT language, kind, count(*) AS n FROM chunks GROUP BY ROLLUP (language, kind)")
def agg_rollup_lang_kind(spark, d):
    return corpus.chunks(spark, d).rollup("language", "kind").agg(F.count("*").alias("n"))


@query("assign_ids", f"WITH {CHUNKS} SELECT path, row_number() OVER (ORDER BY path) + 99 AS id FROM chunks")
def assign_ids(spark, d):
    return changes.assign_ids(corpus.chunks(spark, d).select("path"), ["path"], 100)


@query("chunk_ordinal", "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal, unnest(string_split(text, chr(10))) AS line FROM documents")
def chunk_ordinal(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).withColumn("ordinal", F.col("ordinal").cast("long"))



@query("join_ext_dispatch", f"SELECT doc_id, {_WALKED} AS path, CASE WHEN doc_id % 4 = 0 THEN 'javascript' ELSE 'python' END AS language FROM documents")
def join_ext_dispatch(spark, d):
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return _walked(spark, d).withColumn("language", table[T.extension(F.col("path"))]).where("language IS NOT NULL")


# --- stored tables and streams ----------------------------------------------------------------------------------------


@query("sink_roundtrip", f"WITH {CHUNKS} SELECT id, path, language, end_line, kind FROM chunks")
def sink_roundtrip(spark, d):
    return stored(corpus.chunks(spark, d).repartition("language", F.pmod(F.xxhash64("id"), F.lit(256))), "chunks").select("id", "path", "language", "end_line", "kind")


def _layout(spark: SparkSession, sf_dir: str) -> Layout:
    """A layout of its own; where tables have been dropped their files go too."""
    return Layout(spark, f"layout_{uuid.uuid4().hex}").write(corpus.chunks(spark, sf_dir), corpus.vectors(spark, sf_dir))


@query("layout_join", f"WITH {CHUNKS} SELECT c.id, c.path, round(list_sum(list_transform(e.embedding::DOUBLE[], lambda x: x * x)), 6) AS squares FROM chunks c JOIN embeddings e ON e.vec_id = c.id WHERE c.language = 'de'")
def layout_join(spark, d):
    squares = F.aggregate(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x), F.lit(0.0), lambda a, b: a + b)
    return _rounded(_layout(spark, d).with_vectors("de").select("id", "path", squares.alias("squares")), "squares")


@query("layout_replace", f"WITH {CHUNKS} SELECT id, language, CASE WHEN language IN ('de', 'fr') THEN upper(name) ELSE name END AS name FROM chunks WHERE language NOT IN ('de', 'fr') OR id % 2 = 0")
def layout_replace(spark, d):
    made = _layout(spark, d)
    made.replace(made.chunks.where(F.col("language").isin("de", "fr") & (F.col("id") % 2 == 0)).withColumn("name", F.upper("name")))
    return made.chunks.select("id", "language", "name")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    name = f"tumbling_{uuid.uuid4().hex}"
    counts = streaming.tumbling_counts(streaming.event_stream(spark, d))
    return streaming.stream_to_table(counts, name, f"{shared_dir(spark)}/{name}")


@query("stream_tumbling_append", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)")
def stream_tumbling_append(spark, d):
    """The windows that the watermark has closed, each written once."""
    place = f"{shared_dir(spark)}/tumbling-{uuid.uuid4().hex}"
    streaming.append_to_table(streaming.tumbling_counts(streaming.event_stream(spark, d)), f"{place}/out", f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/out")


#: Events as observations of files, in four parts of eight days; of twenty one comes a part later, of seven one says that
#: the file is gone. What came when a day older than the newest before counts nowhere, what isn't yet a day old waits.
_OBSERVED = """seen AS (SELECT 'user' || user_id || '/' || event_type AS path, floor(value) % 3 AS mtime, (event_id % 3)::BIGINT AS size, event_id % 7 = 0 AS gone, date_trunc('millisecond', ts) AS said,
  least(floor(epoch(date_trunc('millisecond', ts) - TIMESTAMP '2024-01-01') / 691200)::INT + CASE WHEN event_id % 20 = 3 THEN 1 ELSE 0 END, 3) AS part FROM events),
newest_of AS (SELECT p AS part, (SELECT max(said) FROM seen WHERE part < p) AS newest FROM range(4) t(p)),
due AS (SELECT path, CASE WHEN gone THEN 0 ELSE mtime END AS mtime, CASE WHEN gone THEN 0 ELSE size END AS size, gone, said FROM seen JOIN newest_of USING (part)
  WHERE (newest IS NULL OR said > newest - INTERVAL 1 DAY) AND said <= (SELECT max(said) - INTERVAL 1 DAY FROM seen)),
steps AS (SELECT *, lag(gone, 1, true) OVER w AS was_gone, lag(mtime) OVER w AS was_mtime, lag(size) OVER w AS was_size FROM due WINDOW w AS (PARTITION BY path ORDER BY said, mtime, size, gone))"""
_CHANGE = "CASE WHEN gone THEN CASE WHEN NOT was_gone THEN 'removed' END WHEN was_gone THEN 'added' WHEN mtime <> was_mtime OR size <> was_size THEN 'changed' END"


@query("stream_sync_state", f"WITH {_OBSERVED} SELECT path, {_CHANGE} AS status, mtime::DOUBLE AS mtime, size, epoch_ms(said) AS at_ms FROM steps WHERE ({_CHANGE}) IS NOT NULL")
def stream_sync_state(spark, d):
    """Four parts, each taken in by a query of its own that goes on from the checkpoint of the one before."""
    events = corpus.table(spark, d, "events")
    at = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    part = F.floor((F.unix_millis(at) / 1000 - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 691200).cast("int") + F.when(F.col("event_id") % 20 == 3, 1).otherwise(0)
    path = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    seen = events.select(path.alias("path"), (F.floor("value") % 3).cast("double").alias("mtime"), (F.col("event_id") % 3).cast("long").alias("size"), (F.col("event_id") % 7 == 0).alias("gone"), at.alias("at"), F.least(part, F.lit(3)).alias("part"))
    place = f"{shared_dir(spark)}/follow-{uuid.uuid4().hex}"
    rows = stored(seen, "observations")
    for k in range(4):
        rows.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{place}/in")
        state.follow(spark.readStream.schema(rows.drop("part").schema).parquet(f"{place}/in"), f"{place}/out", f"{place}/checkpoint", partitions=8)
    return spark.read.parquet(f"{place}/out").select("path", "status", "mtime", "size", F.unix_millis("at").alias("at_ms"))


@query("stream_sync_foreachbatch", f"WITH {FILES} SELECT path, mtime, size FROM old")
def stream_sync_foreachbatch(spark, d):
    """Four batches: a state of all files, grown in part, then the state before again, in three."""
    place = f"{shared_dir(spark)}/sync-{uuid.uuid4().hex}"
    old, new = corpus.files(spark, d)
    batches = [new.join(old.select("path"), "path", "left_semi").select(*old.columns)] + [old.where(F.pmod(F.xxhash64("path"), F.lit(3)) == k) for k in range(3)]
    for batch in batches:  # of any number of files, each taken in before the next one comes
        batch.write.mode("append").parquet(f"{place}/in")
        last = streaming.sync_stream(spark.readStream.schema(old.schema).parquet(f"{place}/in"), f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out/{last}")


@query("search_scan", f"WITH {BM} SELECT id, round(score, 6) AS score FROM scored")
def search_scan(spark, d):
    """Without an index: tokens are made of the texts."""
    return _rounded(lexical.bm25(corpus.chunks(spark, d), WORDS), "score")


@query("search_postings", f"WITH {BM} SELECT id, round(score, 6) AS score FROM scored")
def search_postings(spark, d):
    _, places, stats = stored_index(spark, d)
    return _rounded(lexical.bm25_postings(places, stats, WORDS), "score")


def _dispatch(mode: str, sql: str) -> None:
    @query(f"search_dispatch_{mode}", sql)
    def run(spark, d):
        return _rounded(_searcher(spark, d, words=mode != "dense").candidates(WORDS, mode=mode), "score")


_ONE = "SELECT id, round(1 / (60 + rank), 6) AS score, {} FROM {}"
_dispatch("bm25", f"WITH {BM} " + _ONE.format("rank AS bm25_rank, NULL::BIGINT AS dense_rank", "bm"))
_dispatch("dense", f"WITH {CHUNKS}, {DENSE} " + _ONE.format("NULL::BIGINT AS bm25_rank, rank AS dense_rank", "near"))
_dispatch("hybrid", f"WITH {BM}, {DENSE}, {FUSED} SELECT id, round(score, 6) AS score, bm25_rank, dense_rank FROM fused")
