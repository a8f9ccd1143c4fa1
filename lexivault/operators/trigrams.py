"""Names by a part of them, without reading all names.

Each different name is listed under each run of three characters in it; the lists are sorted by run. A pattern's literal parts
of three characters or more say which runs a name must hold: their lists are read, the names that stand on all of them are
checked by the pattern itself, and rows are joined by name. A pattern without such a part is checked against the list of
different names, which is read whole. ``%`` and ``_`` are wild cards, as in a symbol look-up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_substring
from ..runtime import stored

SIZE = 3


def runs(name: Column) -> Column:
    """The different runs of three characters in a name."""
    last = F.length(name) - SIZE + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(name, i, F.lit(SIZE))))).otherwise(F.array().cast("array<string>"))


def needed(pattern: str) -> list[str]:
    """Runs that every name with the pattern in it holds."""
    return sorted({part[k : k + SIZE] for part in re.split("[%_]+", pattern) for k in range(len(part) - SIZE + 1)})


@dataclass
class NameIndex:
    """``lists``: ``run, name``, sorted by run; ``names``: the different names."""

    lists: DataFrame
    names: DataFrame

    @classmethod
    def of(cls, rows: DataFrame, column: str = "name") -> NameIndex:
        """Written tables over a column's different names; nulls are in none."""
        names = stored(rows.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct(), "names")
        lists = names.select(F.explode(runs(F.col("name"))).alias("run"), "name")
        return cls(stored(lists.repartitionByRange("run", "name").sortWithinPartitions("run", "name"), "name-runs"), names)

    def find(self, pattern: str) -> DataFrame:
        """``name``: the different names that hold the pattern."""
        asked = needed(pattern)
        if not asked:
            return self.names.where(like_substring(F.col("name"), pattern))
        met = self.lists.where(F.col("run").isin(asked)).groupBy("name").agg(F.count("*").alias("n"))  # once under each run
        return met.where(F.col("n") == len(asked)).where(like_substring(F.col("name"), pattern)).select("name")

    def rows(self, table: DataFrame, pattern: str, column: str = "name") -> DataFrame:
        """The rows of ``table`` whose ``column`` holds the pattern."""
        found = self.find(pattern).select(F.col("name").alias(column))
        return table.join(found, column, "left_semi").select(*table.columns)
