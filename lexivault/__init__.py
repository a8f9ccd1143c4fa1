"""Spark-native hybrid retrieval engine: lexical, dense and code-graph queries over versioned Parquet snapshots."""

__version__ = "0.1.0"
