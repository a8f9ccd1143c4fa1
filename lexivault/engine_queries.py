"""Queries of the parsers, the walker, building and syncing, over sources made of table rows, and their SQL.

Parsers read a source for each row of ``supplier``; what needs a tree of files makes one of ``nation``, whose size is
fixed, in the shared folder, which must be a local or mounted one for it.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import __version__
from .functions.embedding import CHAR_CAP, Backend, HashBackend
from .parsers.registry import EXTENSIONS, parse_files
from .plans.build import Tree, build, sync
from .queries import query
from .runtime import shared_dir, ship
from .sources import corpus
from .sources.store import IndexStore
from .sources.walk import decoded, walk

# --- parsers ----------------------------------------------------------------------------------------------------------

#: By extension: language, source, and what it holds, as (part, first line, last line, kind, name, scope, meta). ``#`` is a
#: row's key; the key's remainder by 5 is the number of empty lines before the source.
SOURCES: dict[str, tuple[str, str, list[tuple]]] = {
    "py": (
        "python",
        "import os\nfrom a.b import c#\n\nLIMIT = #\n\nclass Box#:\n    def open(self):\n        return LIMIT\n\ndef main#():\n    pass\n",
        [
            ("chunk", 4, 4, "module", None, None, None), ("chunk", 6, 8, "class", "Box#", None, None), ("chunk", 7, 8, "function", "open", "Box#", None), ("chunk", 10, 11, "function", "main#", None, None),
            ("symbol", 6, 6, "def", "Box#", None, None), ("symbol", 7, 7, "def", "Box#.open", None, None), ("symbol", 10, 10, "def", "main#", None, None),
            ("edge", 1, 1, "import", "os", None, None), ("edge", 2, 2, "import", "a.b.c#", None, None),
        ],
    ),
    "cs": (
        "csharp",
        "using System.A#;\n\nnamespace N#\n{\n    public class C : B\n    {\n        public int Get(int a)\n        {\n            return a + #;\n        }\n    }\n    record R(int X);\n    enum E { A, B }\n}\n",
        [
            ("chunk", 5, 11, "class", "C", "N#", None), ("chunk", 7, 10, "function", "Get", "N#.C", None), ("chunk", 12, 12, "record", "R", "N#", None), ("chunk", 13, 13, "enum", "E", "N#", None),
            ("symbol", 5, 5, "def", "N#.C", None, None), ("symbol", 7, 7, "def", "N#.C.Get", None, None), ("symbol", 12, 12, "def", "N#.R", None, None), ("symbol", 13, 13, "def", "N#.E", None, None),
            ("edge", 1, 1, "import", "System.A#", None, None),
        ],
    ),
    "js": (
        "javascript",
        'import a#, { b as c } from "m#";\nexport const f# = (y) => y + #;\nexport class K# {\n    run(p) { return #; }\n}\nfunction plain#() {}\n',
        [
            ("chunk", 2, 2, "function", "f#", None, None), ("chunk", 3, 5, "class", "K#", None, None), ("chunk", 4, 4, "function", "run", "K#", None), ("chunk", 6, 6, "function", "plain#", None, None),
            ("symbol", 2, 2, "def", "f#", None, None), ("symbol", 3, 3, "def", "K#", None, None),
            ("edge", 1, 1, "import", "m#", None, '{"names": ["a#", "b"]}'),
        ],
    ),
    "ts": (
        "typescript",
        'import type { T# } from "t#";\nexport interface I# { a: string; }\ntype L# = { x: number };\nnamespace N# {\n    export function g(a: string): void {}\n}\nexport const h# = (a: number): number => a;\n',
        [
            ("chunk", 2, 2, "interface", "I#", None, None), ("chunk", 3, 3, "type", "L#", None, None), ("chunk", 4, 6, "namespace", "N#", None, None), ("chunk", 5, 5, "function", "g", "N#", None), ("chunk", 7, 7, "function", "h#", None, None),
            ("symbol", 2, 2, "def", "I#", None, None), ("symbol", 7, 7, "def", "h#", None, None),
            ("edge", 1, 1, "import", "t#", None, '{"names": ["T#"], "type_only": true}'),
        ],
    ),
    "go": (
        "go",
        'package p#\n\nimport f "fmt#"\n\nvar s# = 1\n\ntype A# struct{}\n\nfunc (a *A#) M() int {\n\treturn #\n}\n\nfunc F#(x int) int {\n\treturn x\n}\n',
        [
            ("chunk", 1, 1, "module", None, None, None), ("chunk", 5, 5, "module", None, None, None), ("chunk", 7, 7, "type", "A#", None, None), ("chunk", 9, 11, "function", "M", "p#.A#", None), ("chunk", 13, 15, "function", "F#", None, None),
            ("symbol", 7, 7, "def", "p#.A#", None, None), ("symbol", 9, 9, "def", "p#.A#.M", None, None), ("symbol", 13, 13, "def", "p#.F#", None, None),
            ("edge", 3, 3, "import", "fmt#", None, '{"alias": "f"}'),
        ],
    ),
    "lsl": (
        "lsl",
        'integer gCount# = 0;\nsay#(string m) {\n    llOwnerSay(m);\n}\ndefault {\n    touch_start(integer n) {\n        llListen(#, "", NULL_KEY, "");\n    }\n}\n',
        [
            ("chunk", 1, 1, "module", None, None, None), ("chunk", 2, 4, "function", "say#", "global", None), ("chunk", 5, 9, "state", "default", None, None), ("chunk", 6, 8, "event", "touch_start", "default", None),
            ("symbol", 1, 1, "def", "gCount#", None, None), ("symbol", 2, 2, "def", "say#", None, None), ("symbol", 3, 3, "ref", "llOwnerSay", None, None), ("symbol", 6, 6, "def", "default.touch_start", None, None), ("symbol", 7, 7, "ref", "llListen", None, None),
            ("edge", 7, 7, "listen", "#", None, None),
        ],
    ),
    "fs": (
        "fsharp",
        "module M#\n\nopen System.A#\n\nlet value# = #\n\nlet add# x =\n    x + value#\n",
        [
            ("chunk", 1, 3, "module", "M#", None, None), ("chunk", 5, 5, "function", "value#", None, None), ("chunk", 7, 8, "function", "add#", None, None),
            ("symbol", 1, 1, "def", "M#", None, None), ("symbol", 5, 5, "def", "value#", None, None), ("symbol", 7, 7, "def", "add#", None, None),
            ("edge", 3, 3, "import", "System.A#", None, None),
        ],
    ),
}


def sources(spark, sf_dir: str, extension: str, language: str | None = None) -> DataFrame:
    """A source for each supplier, as ``parse_files`` takes them."""
    name, text, _ = SOURCES[extension]
    key = F.col("s_suppkey").cast("string")
    content = F.concat(F.expr("repeat('\n', cast(s_suppkey % 5 as int))"), F.replace(F.lit(text), F.lit("#"), key))
    rows = corpus.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key, F.lit(f".{extension}")).alias("path"), F.lit(language or name).alias("language"), content.alias("content"), F.lit(0.0).alias("mtime"), F.lit(None).cast("int").alias("project_order"), "s_suppkey")
    return rows.withColumn("size", F.octet_length("content").cast("long"))


def parts(found: DataFrame) -> DataFrame:
    """Chunks, symbols and edges of parsed files, one below another."""
    none = F.lit(None).cast("string")
    columns = lambda part, first, last, kind, name, scope, meta: [F.col("path"), F.lit(part).alias("part"), *[F.col(c).alias(n) for c, n in ((first, "start_line"), (last, "end_line"), (kind, "kind"), (name, "name"))], scope.alias("scope"), meta.alias("meta")]
    chunk = found.select("path", F.explode("chunks").alias("x")).select(*columns("chunk", "x.start_line", "x.end_line", "x.kind", "x.name", F.col("x.scope"), none))
    symbol = found.select("path", F.explode("symbols").alias("x")).select(*columns("symbol", "x.line", "x.line", "x.kind", "x.name", none, none))
    edge = found.select("path", F.explode("edges").alias("x")).select(*columns("edge", "x.line", "x.line", "x.kind", "x.target", none, F.col("x.meta")))
    return chunk.unionByName(symbol).unionByName(edge)


def _expected(extension: str, only: str = "true", scope: str = "replace(v.scope, '#', s_suppkey::VARCHAR)") -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'"
    rows = ", ".join(f"({text(p)}, {a}, {b}, {', '.join(map(text, rest))})" for p, a, b, *rest in SOURCES[extension][2])
    named = lambda c: f"replace(v.{c}, '#', s_suppkey::VARCHAR)"
    return f"""SELECT 's' || s_suppkey || '.{extension}' AS path, v.part, (v.first_line + s_suppkey % 5)::INT AS start_line, (v.last_line + s_suppkey % 5)::INT AS end_line, v.kind,
  {named('name')} AS name, {scope} AS scope, {named('meta')} AS meta FROM supplier, (VALUES {rows}) v(part, first_line, last_line, kind, name, scope, meta) WHERE {only}"""


def _parser(extension: str) -> None:
    @query(f"parse_{SOURCES[extension][0]}", _expected(extension))
    def run(spark, d):
        return parts(parse_files(sources(spark, d, extension)))


for _extension in SOURCES:
    _parser(_extension)


@query("agg_fsproj_order", _expected("fs", "v.part = 'chunk'", "'|fsproj=' || s_suppkey"))
def agg_fsproj_order(spark, d):
    """Each file at a place of its own in the project."""
    return parts(parse_files(sources(spark, d, "fs").withColumn("project_order", F.col("s_suppkey").cast("int")))).where("part = 'chunk'")


@query("prj_meta_json", """SELECT 's' || s_suppkey || '.js' AS path, 'm' || s_suppkey AS target, '{"names": ["a' || s_suppkey || '", "b"]}' AS meta FROM supplier""")
def prj_meta_json(spark, d):
    return parse_files(sources(spark, d, "js")).select("path", F.explode("edges").alias("e")).select("path", "e.target", "e.meta")


@query("flt_parse_errors", "SELECT 's' || s_suppkey || '.py' AS path, s_suppkey % 3 = 0 AS failed, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 4 END::INT AS chunks FROM supplier")
def flt_parse_errors(spark, d):
    """A third of the files are in a language that nobody reads: each costs itself and no other."""
    good, bad = sources(spark, d, "py").where("s_suppkey % 3 <> 0"), sources(spark, d, "py", "unknown").where("s_suppkey % 3 = 0")
    return parse_files(good.unionByName(bad)).select("path", F.col("error").isNotNull().alias("failed"), F.size("chunks").alias("chunks"))


@query("prj_decode", "SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(65533) || '.' ELSE '' END AS content, doc_id % 3 = 0 AS broken FROM documents")
def prj_decode(spark, d):
    """A third of the texts end in a byte that UTF-8 hasn't, and a full stop."""
    ship(spark)
    rows = corpus.table(spark, d, "documents").select("doc_id", F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FF2E"))).otherwise(F.unhex(F.lit("")))).alias("raw"))
    return rows.select("doc_id", decoded(F.col("raw")).alias("content"), (~F.is_valid_utf8(F.col("raw").cast("string"))).alias("broken"))


class Lengths(Backend):
    """A text's length and the number of texts that come with it at most: what batches and the cap on characters leave."""

    name, dim, device = "lengths", 2, "cpu"

    def __init__(self, most: int):
        self.most = most

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[len(t), len(texts) <= self.most] for t in texts], dtype=np.float32).reshape(len(texts), 2)


@query("embed_batches", f"SELECT doc_id AS id, least(length(text), {CHAR_CAP})::BIGINT AS seen, true AS within FROM documents")
def embed_batches(spark, d):
    ship(spark)
    rows = corpus.chunks(spark, d).select("id", Lengths(16).column(F.col("content"), 16).alias("v"))
    return rows.select("id", F.col("v")[0].cast("long").alias("seen"), (F.col("v")[1] > 0).alias("within"))


# --- trees of files: walking, building, syncing -----------------------------------------------------------------------

#: A language whose parser fails on texts that begin with an exclamation mark.
TOY = """from lexivault.parsers.model import Chunk
class Toy:
    name, extensions = "toy", (".toy",)
    def parse(self, path, text):
        if text.startswith("!"):
            raise ValueError("no text of this language")
        return [Chunk(1, 1, "function", text.strip(), None, text)], [], []
LANGUAGE = Toy()
"""


def _function(key: int, name: str) -> str:
    return f'import os\n\n\ndef f{key}():\n    return "{name}"\n'


#: What ``_function`` gives for a nation, in SQL.
_CONTENT = """'import os' || repeat(chr(10), 3) || 'def f' || n_nationkey || '():' || chr(10) || '    return "' || n_name || '"' || chr(10)"""


def _write(path: Path, content: str | bytes, time: float) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode() if isinstance(content, str) else content)
    os.utime(path, (time, time))


def _tree(spark, sf_dir: str) -> tuple[Path, list]:
    """A new folder with a Python file ``n<key>.py`` for each nation, and the nations."""
    shared = shared_dir(spark)
    if "://" in shared and not shared.startswith("file:"):
        raise ValueError(f"a tree of files needs a local or mounted folder, not {shared}")
    root = Path(shared.removeprefix("file:").replace("//", "/", 1) if shared.startswith("file:") else shared) / f"tree-{uuid.uuid4().hex}"
    nations = corpus.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # 25 rows at every scale
    for key, name in nations:
        _write(root / "src" / f"n{key}.py", _function(key, name), 1000.0 + key)
    return root, nations


def _store(spark, root: Path) -> IndexStore:
    return IndexStore(spark, root / "index")


@query("src_walk", f"""SELECT 'n' || n_nationkey || '.py' AS path, 'python' AS language, (1000 + n_nationkey)::DOUBLE AS mtime, false AS decode_warning, {_CONTENT} AS content FROM nation
UNION ALL SELECT 'sub/b' || n_nationkey || '.py', 'python', 5, true, '# ' || chr(65533) || chr(10) FROM nation WHERE n_nationkey % 5 = 2""")
def src_walk(spark, d):
    """Beside the nations' files: binary ones, excluded folders, other kinds and ignored names, which are left out, and some
    with a byte that isn't UTF-8."""
    root, nations = _tree(spark, d)
    for key, _ in nations:
        _write(root / f"src/node_modules/m{key}.py", "x = 1\n", 5.0)
        _write(root / f"src/t{key}.txt", "text\n", 5.0)
        _write(root / f"src/skip{key}.py", "x = 1\n", 5.0)
        if key % 5 == 1:
            _write(root / f"src/sub/a{key}.py", b"x = 1\0\n", 5.0)
        if key % 5 == 2:
            _write(root / f"src/sub/b{key}.py", b"# \xff\n", 5.0)
    return walk(spark, root / "src", ["skip*.py"]).select("path", "language", "mtime", "decode_warning", "content")


_BUILT = "built AS (SELECT n_nationkey AS key, 'n' || n_nationkey || '.py' AS path, 'f' || n_nationkey AS name, row_number() OVER (ORDER BY 'n' || n_nationkey || '.py') AS id FROM nation)"
_COUNTS = "SELECT count(*) AS files_walked, count(*) AS files_chunked, 0::BIGINT AS files_failed, count(*) AS chunks, count(*) AS symbols, count(*) AS edges"


def _counted(spark, result) -> DataFrame:
    names = ("files_walked", "files_chunked", "files_failed", "chunks", "symbols", "edges")
    return spark.createDataFrame([tuple(int(getattr(result, n)) for n in names)], ", ".join(f"{n} long" for n in names))


@query("build_dry_run", f"{_COUNTS}, false AS written FROM nation")
def build_dry_run(spark, d):
    root, _ = _tree(spark, d)
    store = _store(spark, root)
    return _counted(spark, build(store, Tree(root / "src"), HashBackend(8), dry_run=True)).withColumn("written", F.lit(store.exists()))


@query("build_e2e", f"WITH {_BUILT} SELECT b.id, b.path, 'function' AS kind, b.name, 4 AS start_line, 5 AS end_line, b.name AS symbol, 'os' AS target, 8 AS dim, (1000 + b.key)::DOUBLE AS mtime FROM built b")
def build_e2e(spark, d):
    """Every table of the index, joined."""
    root, _ = _tree(spark, d)
    store = _store(spark, root)
    build(store, Tree(root / "src"), HashBackend(8))
    now = store.open()
    rows = now.table("chunks").select("id", "path", "kind", "name", "start_line", "end_line")
    rows = rows.join(now.table("symbols").select(F.col("chunk_id").alias("id"), F.col("name").alias("symbol")), "id").join(now.table("edges").select(F.col("src_chunk_id").alias("id"), F.col("dst_name").alias("target")), "id")
    return rows.join(now.table("embeddings").select(F.col("chunk_id").alias("id"), F.size("embedding").alias("dim")), "id").join(now.table("files").select("path", "mtime"), "path")


@query("rebuild_idempotent", f"WITH {_BUILT} SELECT id + (SELECT count(*) FROM nation) AS id, path, name FROM built")
def rebuild_idempotent(spark, d):
    """The second build has the same rows under new ids."""
    root, _ = _tree(spark, d)
    store = _store(spark, root)
    for _ in range(2):
        build(store, Tree(root / "src"), HashBackend(8))
    return store.open().table("chunks").select("id", "path", "name")


@query("src_open", f"SELECT 'n' || n_nationkey || '.py' AS path, (1000 + n_nationkey)::DOUBLE AS mtime, length({_CONTENT}) AS size FROM nation")
def src_open(spark, d):
    """The files table of an index that another store object opens."""
    root, _ = _tree(spark, d)
    build(_store(spark, root), Tree(root / "src"), HashBackend(8))
    return _store(spark, root).open().table("files").select("path", "mtime", "size")


@query("meta_kv", f"SELECT * FROM (VALUES ('schema_version', '1'), ('engine_version', '{__version__}'), ('embed_model', 'hash:8'), ('embed_dim', '8'), ('embed_device', 'cpu')) v(key, value) UNION ALL SELECT 'next_id', (1 + count(*))::VARCHAR FROM nation")
def meta_kv(spark, d):
    root, _ = _tree(spark, d)
    store = _store(spark, root)
    build(store, Tree(root / "src"), HashBackend(8))
    return store.open().meta_rows()


def _synced(spark, d: str):
    """Builds an index and syncs it after of ten files one has gone, one has a second function and one has a new
    neighbour."""
    root, nations = _tree(spark, d)
    store, tree = _store(spark, root), Tree(root / "src")
    build(store, tree, HashBackend(8))
    for key, name in nations:
        path = root / "src" / f"n{key}.py"
        if key % 10 == 0:
            path.unlink()
        elif key % 10 == 1:
            _write(path, _function(key, name) + "\n\ndef more():\n    pass\n", 2000.0)
        elif key % 10 == 2:
            _write(root / "src" / f"x{key}.py", _function(key, name), 2000.0)
    return store, sync(store, tree, HashBackend(8))


@query("sync_e2e", f"""WITH {_BUILT}, fresh AS (
  SELECT path, 0 AS ordinal, name FROM built WHERE key % 10 = 1 UNION ALL SELECT path, 1, 'more' FROM built WHERE key % 10 = 1
  UNION ALL SELECT 'x' || key || '.py', 0, name FROM built WHERE key % 10 = 2)
SELECT id, path, name FROM built WHERE key % 10 > 1
UNION ALL SELECT (SELECT count(*) FROM built) + row_number() OVER (ORDER BY path, ordinal), path, name FROM fresh""")
def sync_e2e(spark, d):
    return _synced(spark, d)[0].open().table("chunks").select("id", "path", "name")


@query("sync_id_stability", f"WITH {_BUILT} SELECT id, path, name, id AS symbol_id FROM built WHERE key % 10 > 1")
def sync_id_stability(spark, d):
    """Chunks and symbols of files that nobody touched."""
    now = _synced(spark, d)[0].open()
    rows = now.table("chunks").where("NOT path RLIKE '^x' AND NOT path RLIKE '^n(1|11|21)[.]'").select("id", "path", "name")
    return rows.join(now.table("symbols").select(F.col("id").alias("symbol_id"), F.col("chunk_id").alias("id")), "id")


@query("sync_counts", """SELECT count(*) FILTER (n_nationkey % 10 = 2) AS added, count(*) FILTER (n_nationkey % 10 = 1) AS changed, count(*) FILTER (n_nationkey % 10 > 1) AS unchanged,
  count(*) FILTER (n_nationkey % 10 = 0) AS removed, count(*) FILTER (n_nationkey % 10 > 0) + count(*) FILTER (n_nationkey % 10 IN (1, 2)) AS chunks_total FROM nation""")
def sync_counts(spark, d):
    names = ("added", "changed", "unchanged", "removed", "chunks_total")
    found = _synced(spark, d)[1]
    return spark.createDataFrame([tuple(int(getattr(found, n)) for n in names)], ", ".join(f"{n} long" for n in names))


@query("sync_parse_guard", "SELECT 'n' || n_nationkey || '.toy' AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'old' ELSE 'new' END || n_nationkey AS name FROM nation")
def sync_parse_guard(spark, d):
    """All files change and half of them no longer parse: those keep their old rows."""
    root, nations = _tree(spark, d)
    _write(root / "toy.py", TOY, 1.0)
    store, tree = _store(spark, root), Tree(root / "toys", extensions=EXTENSIONS | {".toy": "toy"}, extra=[str(root / "toy.py")])
    for key, _ in nations:
        _write(root / f"toys/n{key}.toy", f"old{key}\n", 1.0)
    build(store, tree, HashBackend(8))
    for key, _ in nations:
        _write(root / f"toys/n{key}.toy", f"{'!' if key % 2 == 0 else ''}new{key}\n", 2.0)
    sync(store, tree, HashBackend(8))
    return store.open().table("chunks").select("path", "name")
