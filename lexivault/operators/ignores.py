"""Nested ignore files over a table of paths.

An ignore file's lines hold for what lies below its folder, and its last matching line decides for it; what any of the files
above hides is hidden, with all below it. Each different folder and file is looked at once: it is joined by folder to the
lines of the ignore files above it, and paths leave that have something hidden on their way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ignore_regex
from ..runtime import ship, stored
from .skew import salted_join


def _compiled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        regex = [ignore_regex(line) for line in part["line"]]
        yield pd.DataFrame({"folder": part["folder"], "place": part["place"], "regex": pd.Series(regex, dtype="object"), "back": part["line"].str.startswith("!")})


def _way(path: Column) -> Column:
    """The folders on the way to a path, and itself last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def visible(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``paths`` (with ``path``, relative to the root) that no ignore file hides. ``rules``: ``folder`` (``""`` for the root),
    ``place``, ``line``: the lines of the ignore files in their order. Null paths stay; null lines count as blank."""
    ship(paths.sparkSession)
    given = rules.select(F.coalesce("folder", F.lit("")).alias("folder"), F.col("place").cast("long").alias("place"), F.coalesce("line", F.lit("")).alias("line"))
    lines = given.mapInPandas(_compiled, "folder string, place long, regex string, back boolean").where("regex IS NOT NULL")
    ways = paths.select("path", F.posexplode(_way(F.col("path"))).alias("at", "entry")).withColumn("folder_too", F.col("entry") != F.col("path"))
    entries = ways.select("entry", "folder_too").distinct()
    above = F.concat(F.array(F.lit("")), F.slice(_way(F.col("entry")), F.lit(1), F.greatest(F.size(F.split("entry", "/")) - 1, F.lit(0))))
    asked = stored(entries.select("entry", "folder_too", F.explode(above).alias("folder")), "ignore-entries")
    own = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.expr("substr(entry, length(folder) + 2)"))
    met = salted_join(asked.withColumn("own", own), stored(lines, "ignore-lines"), "folder", most=4096, name="ignore")
    hit = met.where(F.expr("own RLIKE regex OR folder_too AND concat(own, '/x') RLIKE regex"))
    last = hit.groupBy("entry", "folder_too", "folder").agg(F.max_by("back", "place").alias("back"))
    hidden = last.where("NOT back").select("entry", "folder_too").distinct()
    gone = ways.join(hidden, ["entry", "folder_too"], "left_semi").select("path").distinct()
    return paths.join(gone, "path", "left_anti").select(*paths.columns)
