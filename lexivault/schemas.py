"""The tables of an index."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _schema(**fields) -> StructType:
    kinds = {"long": LongType(), "int": IntegerType(), "string": StringType(), "double": DoubleType(), "vector": ArrayType(FloatType()), "places": ArrayType(IntegerType())}
    return StructType([StructField(k, kinds[v.removesuffix("?")], v.endswith("?")) for k, v in fields.items()])


CHUNKS = _schema(id="long", path="string", language="string", project="string", start_line="int", end_line="int", kind="string", name="string?", scope="string?", content="string")
EMBEDDINGS = _schema(chunk_id="long", embedding="vector")
SYMBOLS = _schema(id="long", chunk_id="long", name="string", kind="string", line="int")
EDGES = _schema(src_chunk_id="long", dst_name="string", kind="string", meta="string?")
FILES = _schema(path="string", mtime="double", size="long")
POSTINGS = _schema(term="string", id="long", dl="long", content="places", name="places", scope="places")
STATS = _schema(n="long", avgdl="double?")

TABLES = {"chunks": CHUNKS, "embeddings": EMBEDDINGS, "symbols": SYMBOLS, "edges": EDGES, "files": FILES, "postings": POSTINGS, "stats": STATS}
SCHEMA_VERSION = "1"
