"""Languages by name and by extension, and parsing as a Spark function."""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship
from . import csharp, ecma, fsharp, golang, lsl, python
from .model import Chunk, Edge, Symbol

Parser = Callable[[str, str], tuple[list[Chunk], list[Symbol], list[Edge]]]


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    parse: Parser


LANGUAGES: dict[str, Language] = {
    lang.name: lang
    for lang in (
        Language("fsharp", (".fs", ".fsi", ".fsx"), fsharp.parse),
        Language("csharp", (".cs",), csharp.parse),
        Language("javascript", (".js", ".mjs", ".cjs"), ecma.parse_javascript),
        Language("typescript", (".ts", ".tsx"), ecma.parse_typescript),
        Language("go", (".go",), golang.parse),
        Language("python", (".py",), python.parse),
        Language("lsl", (".lsl",), lsl.parse),
    )
}


def extensions(languages: Sequence[Language]) -> dict[str, str]:
    """Extension to language name; of languages that share one, the last has it."""
    return {e.lower(): lang.name for lang in languages for e in lang.extensions}


EXTENSIONS = extensions(list(LANGUAGES.values()))


def load_extra(path: str | Path) -> list[Language]:
    """The languages of a Python file: its ``LANGUAGE`` or ``LANGUAGES``, objects with ``name``, ``extensions`` and either
    ``parse`` or ``chunk``, ``symbols`` and ``imports``."""
    path = Path(path)
    spec = importlib.util.spec_from_file_location(f"lexivault_extra_{path.stem}", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"{path} can't be loaded")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    found = getattr(module, "LANGUAGES", None) or [getattr(module, "LANGUAGE", None)]
    if found == [None]:
        raise ValueError(f"{path} has neither LANGUAGE nor LANGUAGES")
    out = []
    for x in found:
        if not (hasattr(x, "name") and hasattr(x, "extensions")):
            raise ValueError(f"{path}: a language needs a name and extensions")
        own = getattr(x, "parse", None) or (lambda p, t, x=x: (list(x.chunk(Path(p), t)), list(x.symbols(Path(p), t)), list(x.imports(Path(p), t))))
        out.append(Language(x.name, tuple(x.extensions), own))
    return out


@dataclass
class Parsed:
    chunks: list[Chunk] = field(default_factory=list)
    symbols: list[Symbol] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)
    error: str | None = None


def parse(path: str, language: str, content: str, order: int | None = None, languages: dict[str, Language] | None = None) -> Parsed:
    """A file's chunks, symbols and edges, or the error that its parser raised. ``order``: its place in an F# project."""
    try:
        found = Parsed(*(languages or LANGUAGES)[language].parse(path, content))
    except Exception as e:  # noqa: BLE001  a parser's fault costs one file, not the build
        return Parsed(error=f"{type(e).__name__}: {e}")
    if language == "fsharp" and order is not None:
        found.chunks = [Chunk(c.start_line, c.end_line, c.kind, c.name, f"{c.scope or ''}|fsproj={order}", c.text) for c in found.chunks]
    return found


PARSED = (
    "path string, language string, mtime double, size long, "
    "chunks array<struct<start_line:int,end_line:int,kind:string,name:string,scope:string,content:string>>, "
    "symbols array<struct<name:string,kind:string,line:int>>, "
    "edges array<struct<target:string,kind:string,line:int,meta:string>>, error string"
)


def parse_files(files: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """``PARSED`` of ``files`` (``path, language, content, mtime, size, project_order``): one pass of a Python worker over
    each file. ``extra``: files of further languages, read on the executors."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(files.sparkSession)
    sources = {str(p): Path(p).read_text() for p in extra}
    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tempfile

        languages = dict(LANGUAGES)
        for name, text in sources.items():
            with tempfile.TemporaryDirectory() as d:
                copy = Path(d) / Path(name).name
                copy.write_text(text)
                languages |= {x.name: x for x in load_extra(copy)}
        for batch in batches:
            rows, size = [], 0
            for r in batch.to_pylist():
                p = parse(r["path"], r["language"], r["content"], r["project_order"], languages)
                chunks = [{"start_line": c.start_line, "end_line": c.end_line, "kind": c.kind, "name": c.name, "scope": c.scope, "content": c.text} for c in p.chunks]
                edges = [{"target": e.target, "kind": e.kind, "line": e.line, "meta": None if e.meta is None else json.dumps(e.meta)} for e in p.edges]
                rows.append((r["path"], r["language"], r["mtime"], r["size"], chunks, [vars(s) for s in p.symbols], edges, p.error))
                size += 2 * len(r["content"])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("path", "language", "content", "mtime", "size", "project_order").mapInArrow(run, PARSED)
