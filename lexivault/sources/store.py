"""Versioned snapshots of an index: Parquet tables in a folder of their own, and a pointer that is moved at the end.

Readers see the snapshot that the pointer names; a build that fails leaves it as it was. The store is a local or mounted
folder; tables are read and written by Spark.
"""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexError_
from ..schemas import SCHEMA_VERSION, TABLES

POINTER = "_CURRENT"

#: From-version to a function that turns a snapshot's tables and meta into the next version's.
MIGRATIONS: dict[str, tuple[str, object]] = {}


@dataclass
class Snapshot:
    spark: SparkSession
    folder: Path
    meta: dict[str, str]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"file://{self.folder / name}")

    def meta_rows(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.meta.items()), "key string, value string")


class IndexStore:
    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root).absolute()

    def exists(self) -> bool:
        return (self.root / POINTER).is_file()

    def open(self, check_version: bool = True) -> Snapshot:
        if not self.exists():
            raise IndexError_("index.missing", f"there is no index at {self.root}")
        try:
            name = (self.root / POINTER).read_text().strip()
            meta = json.loads((self.root / name / "_meta.json").read_text())
        except (OSError, ValueError) as e:
            raise IndexError_("index.unreadable", f"the index at {self.root} can't be read: {e}") from e
        found = meta.get("schema_version")
        if check_version and found != SCHEMA_VERSION:
            raise IndexError_("index.schema_mismatch", f"the index has schema {found}, this version reads {SCHEMA_VERSION}", found=found, expected=SCHEMA_VERSION)
        return Snapshot(self.spark, self.root / name, meta)

    def write(self, tables: dict[str, DataFrame], meta: dict[str, str]) -> Snapshot:
        """Writes all tables under a new number and then moves the pointer. The last two snapshots stay, as plans may
        still read the one before."""
        self.root.mkdir(parents=True, exist_ok=True)
        numbers = [int(p.name) for p in self.root.iterdir() if p.name.isdigit()]
        number = max(numbers, default=0) + 1
        folder = self.root / str(number)
        try:
            for name, df in tables.items():
                schema = TABLES[name]
                rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
                if name == "postings":
                    rows = rows.repartitionByRange("term").sortWithinPartitions("term", "id")  # a term's rows lie together
                elif name in ("symbols", "edges"):
                    rows = rows.sortWithinPartitions("name" if name == "symbols" else "dst_name")
                rows.write.parquet(f"file://{folder / name}")
            (folder / "_meta.json").write_text(json.dumps({"schema_version": SCHEMA_VERSION} | {k: str(v) for k, v in meta.items()}))
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        fresh = self.root / f"{POINTER}.new"
        fresh.write_text(str(number))
        os.replace(fresh, self.root / POINTER)
        for old in sorted(numbers)[:-1]:
            shutil.rmtree(self.root / str(old), ignore_errors=True)
        return self.open()


def check_model(meta: dict[str, str], name: str, dim: int) -> None:
    """IndexError_ unless the index was embedded by the model ``name`` of ``dim`` dimensions."""
    found = meta.get("embed_dim")
    if found is not None and int(found) != dim:
        raise IndexError_("index.embed_dim_mismatch", f"the index has {found} dimensions, the model {dim}", found=int(found), expected=dim)
    if meta.get("embed_model") not in (None, name):
        raise IndexError_("index.embed_model_mismatch", f"the index was embedded by {meta['embed_model']}, not {name}", found=meta["embed_model"], expected=name)
