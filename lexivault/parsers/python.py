"""Python, by the standard library's syntax trees."""

from __future__ import annotations

import ast

from .model import Chunk, Edge, Source, Symbol, dotted

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_IMPORTS = (ast.Import, ast.ImportFrom)


def _nested(body: list[ast.stmt], scope: str | None):
    for node in body:
        if isinstance(node, _DEFS):
            yield node, scope
            yield from _nested(node.body, dotted(scope, node.name))


def parse(path: str, text: str) -> tuple[list[Chunk], list[Symbol], list[Edge]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], [], []
    source = Source(text, text)
    chunks, symbols, edges = [], [], []
    rest = [n for n in tree.body if not isinstance(n, (*_DEFS, *_IMPORTS))]
    if rest:
        first, last = rest[0].lineno, max(n.end_lineno for n in rest)
        chunks.append(Chunk(first, last, "module", None, None, source.lines(first, last)))
    for node, scope in _nested(tree.body, None):
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        chunks.append(Chunk(node.lineno, node.end_lineno, kind, node.name, scope, source.lines(node.lineno, node.end_lineno)))
        symbols.append(Symbol(dotted(scope, node.name), "def", node.lineno))
    for node in tree.body:
        if isinstance(node, ast.Import):
            edges += [Edge(a.name, "import", node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            origin = "." * node.level + (node.module or "")
            joint = "" if origin.endswith(".") or not origin else "."
            edges += [Edge(f"{origin}{joint}{a.name}", "import", node.lineno) for a in node.names]
    return chunks, symbols, edges
