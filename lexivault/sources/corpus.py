"""Index tables as views over a corpus of documents, vectors and pages in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a chunk."""
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    kind = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), path.alias("path"), F.col("lang").alias("language"), F.lit("corpus").alias("project"), F.lit(1).alias("start_line"),
        F.size(lines(F.col("text"))).alias("end_line"), kind.alias("kind"), F.col("source").alias("name"), F.col("lang").alias("scope"), F.col("text").alias("content"),
    )


def chunk_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What look-ups show of chunks: all but their texts."""
    return chunks(spark, sf_dir).drop("content")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One stored vector, as the embedding of a query."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first capitalised word of a line as a definition, the others as references."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "row"))
    words = rows.select("doc_id", "pos", F.posexplode(F.regexp_extract_all("row", F.lit("(?:^| )([A-Z][A-Za-z]+)"), 1)).alias("k", "name"))
    line = (F.col("pos") + 1).cast("int")
    return words.select((F.col("doc_id") * 100_000_000 + F.col("pos") * 10_000 + F.col("k")).cast("long").alias("id"), F.col("doc_id").alias("chunk_id"), "name", F.when(F.col("k") == 0, "def").otherwise("ref").alias("kind"), line.alias("line"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a chunk whose path is its URL."""
    lang = F.regexp_extract("html", '<html lang="([^"]*)"', 1)
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"), lang.alias("language"), F.lit(1).alias("start_line"), host.alias("scope"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link of a page as an edge."""
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("src_chunk_id"), links.alias("dst_name")).select("src_chunk_id", "dst_name", F.lit("import").alias("kind"), F.lit(None).cast("string").alias("meta"))


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An old and a new state of the documents as files: of ten, one is only in the new, one only in the old, one has grown."""
    base = chunks(spark, sf_dir).select("id", "path", (F.col("id") * 1.5).cast("double").alias("mtime"), F.length("content").cast("long").alias("size"))
    part = F.col("id") % 10
    old = base.where(part != 0).select("path", "mtime", "size")
    new = base.where(part != 1).select("path", "mtime", (F.col("size") + F.when(part == 2, 1).otherwise(0)).cast("long").alias("size"))
    return old, new
