"""A corpus from raw documents to packed sequences: language, near duplicates, mixture, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``. Null ids and texts, repeated rows and empty
tables have the results that the operators' docstrings state. Columns that a stage doesn't know pass through it, whatever
their names: a row travels as one struct beside the columns that the stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivault.llm._shared import stored
from lexivault.llm.jaccard_join import jaccard_components
from lexivault.llm.language_id import UNKNOWN, fit_language_model, identify
from lexivault.llm.mixing import mixed_documents
from lexivault.llm.packing import pack

#: The languages that the corpus keeps; None for all that its labels teach.
LANGUAGES: tuple[str, ...] | None = None
#: A text of at least so many letters goes where the network puts it in no language with this probability, or in one that
#: isn't kept. Fewer letters don't tell.
LEAST_LETTERS, MOST_NOISE = 64, 0.8
#: Windows of text that the network must have been fitted on before its word counts against a text.
LEAST_FITTED = 200


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: null texts, those without a letter and, by the network's pooled probabilities,
    those of ``LEAST_LETTERS`` letters or more that are keys, dumps or other runs in no language, or in a language that
    isn't among ``LANGUAGES``. All others stay as they are, short and mixed ones too. Where nothing or too little is
    labelled to know a language, only texts without a letter go."""
    row = docs.select(F.struct(*_all(docs)).alias("row"), "text")
    model = fit_language_model(docs.select("doc_id", "text", "lang"))
    if model is None or model.fitted < LEAST_FITTED:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    seen = identify(row, model, keep=("row",))
    unwanted = F.col("noise") >= MOST_NOISE
    if LANGUAGES is not None:
        unwanted |= ~F.col("lang_pred").isin(*LANGUAGES)
    long = F.length(F.regexp_replace("row.text", r"\P{L}+", "")) >= LEAST_LETTERS
    return seen.where((F.col("lang_pred") != UNKNOWN) & ~(unwanted & long)).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose sets of five-word shingles link them at a similarity of 0.8 or more, that with the
    smallest doc_id stays. It is decided by doc_id and text, so of a repeated doc_id only the texts that are copies go; of
    rows with equal doc_id and text one stays, that with the smallest hash of all its columns. Rows with a null doc_id
    stay."""
    found = jaccard_components(docs.select("doc_id", "text"), k=5, num=80, den=100)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(F.struct(*_all(docs)).alias("row"), F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    left = rows.join(gone, (F.col("row.doc_id") == F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_anti")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias("_id"))
    if again.isEmpty():
        return left.select("row.*")
    same = F.col("row.doc_id") == F.col("_id")
    several = left.join(again, same, "left_semi")
    order = F.struct(F.xxhash64(F.to_json("row")), F.to_json("row"))
    once = several.groupBy("row.doc_id", "hash").agg(F.min_by("row", order).alias("row")).select("row")
    return left.join(again, same, "left_anti").select("row").union(once).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands in the mix as often as the schedule takes words of it: not at all, once or twice, in the order of
    the slots that its copies begin in. One that the schedule's end cuts, one a source at most, stands whole."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids."""
    return pack(docs.select("doc_id", "text"))


def _all(docs: DataFrame) -> list:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


STAGES = [
    ("language identification", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Neither the network nor the packing is SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return docs
