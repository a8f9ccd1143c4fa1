"""Go, by its top-level declarations: each begins at a line's start with a keyword."""

from __future__ import annotations

import re

from .model import Chunk, Edge, Source, Symbol, blank, closing, dotted

_HIDDEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'", re.S)
_TOP = re.compile(r"^(package|import|const|var|type|func)\b", re.M)
_SPEC = re.compile(r'(?:^|[(;\n])\s*(?:([\w.]+)\s+)?(["`])')
_METHOD = re.compile(r"func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)\s*(\[)?[^)]*\)\s*(\w+)")


def _end(code: str, at: int) -> int:
    """Where the declaration at ``at`` ends: at the first line end outside brackets that the line before doesn't
    leave open."""
    k = at
    while k < len(code):
        if code[k] in "([{":
            k = closing(code, k) + 1
            continue
        if code[k] == "`":
            k = code.find("`", k + 1) + 1 or len(code)
            continue
        if code[k] == "\n" and not re.search(r"[=,+\-*/|&<>:(\[{]\s*\Z", code[at:k]):
            return k
        k += 1
    return len(code)


def parse(path: str, text: str) -> tuple[list[Chunk], list[Symbol], list[Edge]]:
    s = Source(text, blank(text, _HIDDEN))
    chunks, symbols, edges = [], [], []
    package = None
    at = 0
    while found := _TOP.search(s.code, at):
        begin, word = found.start(), found[1]
        at = end = _end(s.code, begin)
        own = s.code[begin:end]
        if word == "package":
            name = re.match(r"package\s+(\w+)", own)
            package = name[1] if name else None
        if word in ("package", "const", "var"):
            chunks.append(s.chunk(begin, end, "module", None, None))
        elif word == "import":
            skip = len("import")
            for m in _SPEC.finditer(own[skip:]):
                open_at = begin + skip + m.end() - 1
                close = s.text.find(m[2], open_at + 1)
                edges.append(Edge(s.text[open_at + 1 : close], "import", s.line(open_at), {"alias": m[1]} if m[1] else None))
        elif word == "type":
            name = re.match(r"type\s*(?:\(\s*)?(\w+)", own)
            if name:
                chunks.append(s.chunk(begin, end, "type", name[1], None))
                symbols.append(Symbol(dotted(package, name[1]), "def", s.line(begin)))
        elif word == "func":
            if method := _METHOD.match(own):
                receiver = None if method[2] else method[1]
                scope = dotted(package, receiver)
                chunks.append(s.chunk(begin, end, "function", method[3], scope))
                symbols.append(Symbol(dotted(scope, method[3]), "def", s.line(begin)))
            elif name := re.match(r"func\s+(\w+)", own):
                chunks.append(s.chunk(begin, end, "function", name[1], None))
                symbols.append(Symbol(dotted(package, name[1]), "def", s.line(begin)))
    return chunks, symbols, edges
