"""A source tree as a DataFrame of files.

The driver lists the tree, as only it can follow links, find cycles and read ignore files on the way; names, sizes and
times are all it holds. Executors read the contents of the files that are left.
"""

from __future__ import annotations

import logging
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import SIZE_CAP, ignore_regex, is_binary
from ..parsers.registry import EXTENSIONS

log = logging.getLogger(__name__)

#: Folders that are never indexed; fixed values, in the syntax of ignore files.
DEFAULT_EXCLUDES = (
    ".git/", ".hg/", ".svn/", "node_modules/", "bower_components/", ".venv/", "venv/", "__pycache__/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/",
    "*.egg-info/", "dist/", "build/", "out/", "target/", "bin/", "obj/", ".idea/", ".vscode/", "docs/.helpers/",
)
#: Folders above a file in which its project file is looked for.
PROJECT_LEVELS = 6


@dataclass(frozen=True)
class Listed:
    path: str  # absolute
    rel_path: str
    language: str
    mtime: float
    size: int
    project_order: int | None = None


class _Ignore:
    """The lines of an ignore file, matched against paths relative to its folder."""

    def __init__(self, folder: str, lines: Sequence[str]):
        self.folder = folder
        self.rules = [(re.compile(r), line.startswith("!")) for line in lines if (r := ignore_regex(line)) is not None]

    def hides(self, rel: str, is_folder: bool) -> bool:
        own = rel[len(self.folder) + 1 :] if self.folder else rel
        hidden = False
        for rule, back in self.rules:
            if rule.search(own) or is_folder and rule.search(own + "/x"):
                hidden = not back
        return hidden


def list_files(root: str | Path, ignores: Sequence[str] = (), extensions: dict[str, str] | None = None, roots: Sequence[str] = (".",)) -> Iterator[Listed]:
    """The files of the tree that are of a known language and small enough. Links are followed; a link to a folder that the
    path is already in, and one to nothing, is passed over with a warning."""
    top = Path(root).resolve()
    known = EXTENSIONS if extensions is None else extensions
    fixed = [_Ignore("", DEFAULT_EXCLUDES), _Ignore("", ignores)]
    read_ignore = (top / ".git").exists()

    def visit(folder: Path, rel: str, above: tuple[str, ...], rules: list[_Ignore]) -> Iterator[Listed]:
        real = os.path.realpath(folder)
        if real in above:
            log.warning("%s: a link to a folder above it", folder)
            return
        if read_ignore and (own := folder / ".gitignore").is_file():
            rules = [*rules, _Ignore(rel, own.read_text(errors="replace").splitlines())]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            log.warning("%s: %s", folder, e)
            return
        for e in entries:
            name = f"{rel}/{e.name}" if rel else e.name
            try:
                is_folder = e.is_dir()
                if any(r.hides(name, is_folder) for r in rules):
                    continue
                if is_folder:
                    yield from visit(Path(e.path), name, (*above, real), rules)
                    continue
                language = known.get(Path(e.name).suffix.lower())
                if language is None:
                    if e.is_symlink() and not os.path.exists(e.path):
                        log.warning("%s: a link to nothing", e.path)
                    continue
                stat = e.stat()
            except OSError as error:
                log.warning("%s: %s", e.path, error)
                continue
            if stat.st_size > SIZE_CAP:
                log.warning("%s: larger than %d bytes", e.path, SIZE_CAP)
                continue
            yield Listed(e.path, name, language, stat.st_mtime, stat.st_size)

    for r in roots:
        start = (top / r).resolve()
        rel = "" if start == top else start.relative_to(top).as_posix()
        yield from visit(start, rel, (), list(fixed))


def project_orders(project: Path) -> dict[str, int]:
    """Absolute path to place of the files that an F# project compiles; empty if it can't be read."""
    try:
        tree = ET.parse(project)
    except (ET.ParseError, OSError) as e:
        log.warning("%s: %s", project, e)
        return {}
    found = [e.get("Include") for e in tree.iter() if e.tag.rpartition("}")[2] == "Compile" and e.get("Include")]
    return {os.path.realpath(project.parent / p.replace("\\", "/")): k for k, p in enumerate(found)}


def with_projects(files: Sequence[Listed]) -> list[Listed]:
    """F# files with their place in the nearest project file above them."""
    projects: dict[Path, dict[str, int]] = {}

    def orders(folder: Path) -> dict[str, int]:
        if folder not in projects:
            near = next((p for up in [folder, *folder.parents][: PROJECT_LEVELS + 1] for p in sorted(up.glob("*.fsproj"))[:1]), None)
            projects[folder] = project_orders(near) if near else {}
        return projects[folder]

    return [Listed(f.path, f.rel_path, f.language, f.mtime, f.size, orders(Path(f.path).parent).get(os.path.realpath(f.path))) if f.language == "fsharp" else f for f in files]


LISTED = "file string, path string, language string, mtime double, size long, project_order int"


def listing(spark: SparkSession, files: Sequence[Listed]) -> DataFrame:
    """Names, sizes and times; nothing is read."""
    return spark.createDataFrame([(f.path, f.rel_path, f.language, float(f.mtime), f.size, f.project_order) for f in files], LISTED)


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", errors="replace"))


def decoded(content):
    """UTF-8 text; malformed parts become replacement characters as Python has them, by a Python worker for such files only."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(_decoded(F.when(~F.is_valid_utf8(content.cast("string")), content).otherwise(F.lit(b""))))


def read_files(spark: SparkSession, files: Sequence[Listed]) -> DataFrame:
    """``path, language, mtime, size, project_order, content, decode_warning`` of the listed files that aren't binary."""
    if not files:
        return spark.createDataFrame([], "path string, language string, mtime double, size long, project_order int, content string, decode_warning boolean")
    names = listing(spark, files)
    raw = spark.read.format("binaryFile").load([f.path.replace("\\", "\\\\").replace("{", "\\{").replace("[", "\\[").replace("*", "\\*").replace("?", "\\?") for f in files])
    raw = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("file"), "content").where(~is_binary(F.col("content")))
    text = raw.select("file", decoded(F.col("content")).alias("content"), (~F.is_valid_utf8(F.col("content").cast("string"))).alias("decode_warning"))
    return names.join(text, "file").drop("file").select("path", "language", "mtime", "size", "project_order", "content", "decode_warning")


def walk(spark: SparkSession, root: str | Path, ignores: Sequence[str] = (), extensions: dict[str, str] | None = None, roots: Sequence[str] = (".",)) -> DataFrame:
    """The tree's files with their contents."""
    return read_files(spark, with_projects(list(list_files(root, ignores, extensions, roots))))
