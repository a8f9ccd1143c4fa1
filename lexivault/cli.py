"""The command line: every command is a function from arguments to a JSON document and its text form."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .config import Config, find_config, load_config, write_skeleton
from .errors import IndexError_, as_error
from .functions.embedding import Backend, from_config, resolve_device
from .functions.fts import QuerySyntaxError
from .operators import catalog, lsi  # noqa: F401  lsi makes its backend known
from .parsers.registry import LANGUAGES
from .plans.build import build, sync
from .plans.search import MODES, Filters, Searcher
from .sources.store import IndexStore, Snapshot, check_model

DEVICE = "LEXIVAULT_DEVICE"
TOPICS = ("usage", "init", "index-build", "index-sync", "index-rebuild", "search", "symbols", "graph", "config-show")
#: Result and its text; a command returns both.
Result = tuple[dict | list, str]


def session() -> SparkSession:
    builder = SparkSession.builder.appName("lexivault").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    if not os.environ.get("SPARK_MASTER") and SparkSession.getActiveSession() is None:
        builder = builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    return builder.getOrCreate()


def _config(a) -> Config:
    return load_config(Path(a.config) if a.config else find_config(Path.cwd()))


def _backend(c: Config) -> Backend:
    return from_config(c.embed_backend, c.embed_model, os.environ.get(DEVICE))


def _open(c: Config, check: bool = True) -> Snapshot:
    store = IndexStore(session(), c.index_path) if c.index_path.exists() else None
    if store is None:
        raise IndexError_("index.missing", f"there is no index at {c.index_path}; run 'index build'")
    found = store.open()
    if check:
        b = _backend(c)
        check_model(found.meta, b.name, b.dim)
    return found


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _language(name: str | None, c: Config) -> None:
    known = set(LANGUAGES) | set(c.active().values())
    if name is not None and name not in known:
        raise IndexError_("cli.bad_enum", f"no such language: {name}", allowed=sorted(known))


def do_init(a) -> Result:
    out = write_skeleton(Path.cwd(), a.name, a.force)
    return out, f"wrote {out['config_path']}"


def do_build(a) -> Result:
    c = _config(a)
    r = build(IndexStore(session(), c.index_path), c.tree(Path(a.root) if a.root else None), _backend(c), a.dry_run)
    out = {
        "files_walked": r.files_walked, "files_chunked": r.files_chunked, "chunks_chunked": r.chunks, "chunks_inserted": 0 if r.dry_run else r.chunks,
        "symbols_inserted": 0 if r.dry_run else r.symbols, "edges_inserted": 0 if r.dry_run else r.edges, "seconds_elapsed": r.seconds,
    }
    return out, f"{r.files_chunked} files, {r.chunks} chunks, {r.symbols} symbols, {r.edges} edges in {r.seconds:.1f} s"


def do_sync(a) -> Result:
    c = _config(a)
    _open(c)
    r = sync(IndexStore(session(), c.index_path), c.tree(), _backend(c))
    out = {"files_added": r.added, "files_changed": r.changed, "files_unchanged": r.unchanged, "files_removed": r.removed, "chunks_inserted_total": r.chunks_total, "seconds_elapsed": r.seconds}
    return out, f"{r.added} added, {r.changed} changed, {r.unchanged} unchanged, {r.removed} removed; {r.chunks_total} chunks"


def do_rebuild(a) -> Result:
    if not a.yes:
        raise IndexError_("usage.confirmation_required", "index rebuild needs --yes")
    a.root, a.dry_run = None, False
    return do_build(a)


def do_search(a) -> Result:
    c = _config(a)
    if a.mode not in MODES:
        raise IndexError_("cli.bad_enum", f"no such mode: {a.mode}", allowed=list(MODES))
    if min(a.k, a.bm25_k, a.dense_k) < 1:
        raise IndexError_("cli.bad_enum", "--k, --bm25-k and --dense-k must be at least 1")
    _language(a.lang, c)
    found = _open(c, check=a.mode != "bm25")  # words alone need no model
    s = Searcher(found.table("chunks"), found.table("embeddings"), lambda q: _backend(c).query(q), found.table("postings"), found.table("stats"))
    rows = _rows(s.search(a.query, a.mode, a.k, a.bm25_k, a.dense_k, Filters(a.lang, a.kind, a.path), sanitize=a.sanitize))
    stanzas = []
    for r in rows:
        more = ([f"score={r['score']}"] if a.verbose else []) + ([r["scope"]] if r["scope"] is not None else []) + r["excerpt"].splitlines()
        stanzas.append("\n  ".join([f"{r['path']}:{r['start_line']}-{r['end_line']}  [{r['language']}] {r['kind']} {r['name'] or ''}", *more]))
    return {"results": rows}, "\n\n".join(stanzas)


def do_symbols(a) -> Result:
    found = _open(_config(a))
    rows = _rows(catalog.symbols(found.table("symbols"), found.table("chunks"), a.name, a.what.removesuffix("s"), a.exact, a.lang))
    return rows, "\n".join(f"{r['path']}:{r['line']}  [{r['language']}] {r['name']}" for r in rows)


def do_callers(a) -> Result:
    found = _open(_config(a))
    rows = _rows(catalog.callers(found.table("edges"), found.table("chunks"), a.symbol, a.exact, a.lang))
    return rows, "\n".join(f"{r['path']}:{r['start_line']}  [{r['language']}] {r['kind']} {r['dst_name']}" for r in rows)


def do_deps(a) -> Result:
    found = _open(_config(a))
    rows = _rows(catalog.deps(found.table("edges"), found.table("chunks"), a.path, a.lang))
    return rows, "\n".join(f"{r['kind']} {r['dst_name']}" + (f"  {r['meta']}" if r["meta"] else "") for r in rows)


def do_config_show(a) -> Result:
    c = _config(a)
    store = IndexStore(session(), c.index_path) if c.index_path.exists() else None
    meta = None
    if store is not None and store.exists():
        raw = store.open(check_version=False).meta
        meta = {k: raw.get(k, "") for k in ("schema_version", "engine_version", "embed_model", "embed_dim", "embed_device")}
    requested = os.environ.get(DEVICE) or "auto"
    out = {"config": c.as_dict(), "index": meta, "requested_device": requested, "effective_device": resolve_device(requested)}
    block = lambda name, d: "\n".join([f"{name}:", *(f"  {k}: {v}" for k, v in d.items())])
    shown = dict(sorted(out["config"].items()))
    index = "index: not built"
    if meta is not None:
        drift = meta["embed_model"] not in ("", c.embed_model)
        index = block("index", {k: v + " [mismatch]" * (drift and k == "embed_model") for k, v in sorted(meta.items())})
    device = block("device", {k: out[k] for k in ("requested_device", "effective_device")})
    return out, "\n\n".join([block("config", shown), index, device])


def do_usage(a) -> Result:
    topic = a.topic or "usage"
    if topic not in TOPICS:
        raise IndexError_("cli.bad_enum", f"no such topic: {topic}", allowed=list(TOPICS))
    text = (Path(__file__).parent / "usage" / f"{topic}.md").read_text()
    return {"topic": topic, "content": text, "available": list(TOPICS)}, text


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise IndexError_("usage.bad_arguments", message)


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--config")
    shared.add_argument("--format", choices=("text", "json"), default="text")
    shared.add_argument("--verbose", action="store_true")
    shared.add_argument("--quiet", action="store_true", help="no progress and no warnings")
    top = _Parser(prog="lexivault", description="Hybrid search over code and text, on Spark.")
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)

    def add(into, name: str, run: Callable, *options) -> None:
        p = into.add_parser(name, parents=[shared])
        for flags, more in options:
            p.add_argument(*flags, **more)
        p.set_defaults(run=run)

    flag = lambda *f, **k: (f, k)
    on = {"action": "store_true"}
    lang, exact = flag("--lang"), flag("--exact", **on)
    add(commands, "init", do_init, flag("--name"), flag("--force", **on))
    index = commands.add_parser("index").add_subparsers(dest="what", required=True, parser_class=_Parser)
    add(index, "build", do_build, flag("--root"), flag("--dry-run", **on))
    add(index, "sync", do_sync)
    add(index, "rebuild", do_rebuild, flag("--yes", **on))
    number = {"type": int}
    add(commands, "search", do_search, flag("query"), lang, flag("--k", default=20, **number), flag("--bm25-k", default=100, **number), flag("--dense-k", default=100, **number), flag("--kind"), flag("--path"), flag("--mode", default="hybrid"), flag("--sanitize", **on))
    symbols = commands.add_parser("symbols").add_subparsers(dest="what", required=True, parser_class=_Parser)
    add(symbols, "defs", do_symbols, flag("name"), exact, lang)
    add(symbols, "refs", do_symbols, flag("name"), exact, lang)
    graph = commands.add_parser("graph").add_subparsers(dest="what", required=True, parser_class=_Parser)
    add(graph, "callers", do_callers, flag("symbol"), exact, lang)
    add(graph, "deps", do_deps, flag("path"), lang)
    config = commands.add_parser("config").add_subparsers(dest="what", required=True, parser_class=_Parser)
    add(config, "show", do_config_show)
    add(commands, "usage", do_usage, flag("topic", nargs="?"))
    return top


def main(args: Sequence[str] | None = None) -> int:
    """Runs a command. Results go to standard output, errors to standard error or, with ``--format json``, to standard
    output as an envelope; the exit code tells the kind."""
    args = list(sys.argv[1:] if args is None else args)
    as_json = any(a == "--format=json" or a == "--format" and args[k + 1 : k + 2] == ["json"] for k, a in enumerate(args))
    try:
        a = parser().parse_args(args)
        if a.quiet:
            import logging

            logging.disable(logging.WARNING)
        out, text = a.run(a)
        shown = json.dumps(out, ensure_ascii=False) if as_json else text
        if shown:
            print(shown)
        return 0
    except QuerySyntaxError as e:
        error = IndexError_("usage.query_syntax", str(e))
    except Exception as e:  # noqa: BLE001  the boundary: every fault has a code
        error = as_error(e)
    if as_json:
        print(json.dumps(error.envelope(), ensure_ascii=False))
    else:
        print(f"error: {error.message} ({error.kind})", file=sys.stderr)
    return error.code


if __name__ == "__main__":
    sys.exit(main())
