"""How an index's tables lie on disk: chunks in a folder for each language, chunks and vectors in buckets of their ids.

A filter on the language reads its folders only. Chunks and vectors of equal ids are in files of one number, sorted, so a join on
the id moves nothing. Some languages can be written anew without touching the others. Tables are Spark's own, in its
warehouse, as buckets need a table that knows of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import stored

BUCKETS = 16
MODE = "spark.sql.sources.partitionOverwriteMode"


@dataclass(frozen=True)
class Layout:
    """Tables ``<name>_chunks`` (with ``id`` and ``language``) and ``<name>_vectors`` (``chunk_id, embedding``)."""

    spark: SparkSession
    name: str
    buckets: int = BUCKETS

    @property
    def chunks(self) -> DataFrame:
        return self.spark.table(f"{self.name}_chunks")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.table(f"{self.name}_vectors")

    def write(self, chunks: DataFrame, vectors: DataFrame) -> Layout:
        # rows of a bucket are brought together first, so that each task writes few files
        dealt = lambda df, key: df.repartition(self.buckets, key)
        dealt(chunks, "id").write.mode("overwrite").partitionBy("language").bucketBy(self.buckets, "id").sortBy("id").saveAsTable(f"{self.name}_chunks")
        dealt(vectors, "chunk_id").write.mode("overwrite").bucketBy(self.buckets, "chunk_id").sortBy("chunk_id").saveAsTable(f"{self.name}_vectors")
        return self

    def replace(self, chunks: DataFrame) -> None:
        """Writes the languages that ``chunks`` has anew; others stay as they are. Chunks may be made of the table itself."""
        rows = stored(chunks.select(*self.chunks.columns), "layout-chunks")
        before = self.spark.conf.get(MODE, None)
        self.spark.conf.set(MODE, "dynamic")
        try:
            rows.repartition(self.buckets, "id").write.mode("overwrite").insertInto(f"{self.name}_chunks")
        finally:
            if before is None:
                self.spark.conf.unset(MODE)
            else:
                self.spark.conf.set(MODE, before)

    def with_vectors(self, language: str | None = None) -> DataFrame:
        """Chunks with their vectors: a join of buckets, of one language's folder if one is given."""
        own = self.chunks if language is None else self.chunks.where(F.col("language") == language)
        return own.hint("merge").join(self.vectors.withColumnRenamed("chunk_id", "id"), "id")

    def drop(self) -> None:
        for table in ("chunks", "vectors"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
