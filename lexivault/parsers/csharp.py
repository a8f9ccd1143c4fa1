"""C#, by brackets and declaration heads over text without comments and strings."""

from __future__ import annotations

import re

from .model import Chunk, Edge, Source, Symbol, blank, closing, dotted, skip_space

_HIDDEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|\$*"""+.*?"""+|\$?@\$?"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\'|^[ \t]*\#[^\n]*', re.S | re.M)
_NAMESPACE = re.compile(r"namespace\s+([\w.]+)\s*\Z")
_TYPE = re.compile(r"(?:^|\s)(record\s+struct|record\s+class|class|struct|record|interface|enum)\s+(\w+)")
_USING = re.compile(r"(?:global\s+)?using\s+(?!\()(?:static\s+|unsafe\s+)?(?:\w+\s*=\s*)?([\w.]+)")
_METHOD = re.compile(r"(?:^|[\s*>\]?.])(~?\w+)\s*(?:<[^<>()]*>\s*)?\Z")
_LOCAL = re.compile(r"^(?:(?:static|async|unsafe|extern)\s+)*(?!(?:return|new|await|throw|else|yield|using|lock|if|for|foreach|while|switch|case|when|goto|in|out|ref\s+var|var)\b)[\w.<>\[\],?\s()]*[\w>\]?)]\s+(\w+)\s*(?:<[^<>()]*>\s*)?\Z")
_WORDS = frozenset("if for foreach while switch catch using lock fixed return new typeof sizeof nameof default checked unchecked when base this get set init add remove operator delegate".split())


class _Scan:
    def __init__(self, text: str):
        self.s = Source(text, blank(text, _HIDDEN))
        self.chunks: list[Chunk] = []
        self.symbols: list[Symbol] = []
        self.edges: list[Edge] = []
        self.loose: list[tuple[int, int]] = []

    def add(self, begin: int, end: int, kind: str, name: str, scope: str | None) -> None:
        self.chunks.append(self.s.chunk(begin, end, kind, name, scope))
        self.symbols.append(Symbol(dotted(scope, name), "def", self.s.line(begin)))

    def statements(self, at: int, end: int):
        """``(begin, head end, stop, body)`` of each statement: ``body`` is the offset of its block's bracket or -1."""
        code = self.s.code
        while (at := skip_space(code, at, end)) < end:
            if code[at] in "};,)]":
                at += 1
                continue
            k, assigned = at, False
            while k < end:
                c = code[k]
                assigned |= c == "=" and code[k + 1 : k + 2] not in ("=", ">") and code[k - 1] not in "=!<>"
                if c == "{":
                    stop = closing(code, k, end) + 1
                    after = skip_space(code, stop, end)
                    # an initializer or a property's value goes on to its semicolon
                    if assigned or after < end and (code[after] == "=" and code[after : after + 2] != "=="):
                        k = stop
                        continue
                    yield at, k, stop, k
                    at = stop
                    break
                if c in "([":
                    k = closing(code, k, end) + 1
                    continue
                if c == ";":
                    yield at, k, k + 1, -1
                    at = k + 1
                    break
                k += 1
            else:
                yield at, end, end, -1
                return

    def head(self, begin: int, end: int) -> str:
        """A declaration's head without attributes."""
        text = self.s.code[begin:end]
        while (text := text.lstrip()).startswith("["):
            text = text[closing(text, 0) + 1 :]
        return text

    def container(self, at: int, end: int, scope: str | None, top: bool) -> None:
        for begin, stop_head, stop, body in self.statements(at, end):
            head = self.head(begin, stop_head)
            if found := _NAMESPACE.match(head):
                if body >= 0:
                    self.container(body + 1, stop - 1, dotted(scope, found[1]), False)
                continue
            if top and (found := _USING.match(head)) and body < 0:
                self.edges.append(Edge(found[1], "import", self.s.line(begin)))
                continue
            if found := self.type(head):
                kind, name = found
                self.add(begin, stop, kind, name, scope)
                if body >= 0 and kind != "enum":
                    self.members(body + 1, stop - 1, dotted(scope, name), name)
            elif top:
                self.loose.append((begin, stop))

    def type(self, head: str) -> tuple[str, str] | None:
        before = re.split(r"[=(]", head, maxsplit=1)[0]
        found = _TYPE.search(before)
        return (found[1].split()[0], found[2]) if found else None

    def members(self, at: int, end: int, scope: str, own: str) -> None:
        for begin, stop_head, stop, body in self.statements(at, end):
            head = self.head(begin, stop_head)
            if found := self.type(head):
                kind, name = found
                self.add(begin, stop, kind, name, scope)
                if body >= 0 and kind != "enum":
                    self.members(body + 1, stop - 1, dotted(scope, name), name)
                continue
            name = self.method(head)
            if name is None:
                continue
            self.add(begin, stop, "function", name, scope)
            if body >= 0:
                self.locals(body + 1, stop - 1, dotted(scope, name))

    def method(self, head: str) -> str | None:
        paren = head.find("(")
        if paren < 0 or re.search(r"=(?!>)", head[:paren]) or re.search(r"\b(?:delegate|operator|event)\b", head[:paren]):
            return None
        found = _METHOD.search(head[:paren])
        return found[1] if found and found[1] not in _WORDS and not found[1].startswith("~") else None

    def locals(self, at: int, end: int, scope: str) -> None:
        for begin, stop_head, stop, body in self.statements(at, end):
            head = self.s.code[begin:stop_head]
            paren = head.find("(")
            found = _LOCAL.match(head[:paren]) if paren > 0 else None
            if found and found[1] not in _WORDS:
                rest = head[closing(head, paren) + 1 :].strip()
                if body >= 0 and (not rest or rest.startswith("where")) or rest.startswith("=>"):
                    self.add(begin, stop, "function", found[1], scope)
                    if body >= 0:
                        self.locals(body + 1, stop - 1, dotted(scope, found[1]))
                    continue
            if body >= 0:
                self.locals(body + 1, stop - 1, scope)


def parse(path: str, text: str) -> tuple[list[Chunk], list[Symbol], list[Edge]]:
    scan = _Scan(text)
    scan.container(0, len(text), None, True)
    if scan.loose:
        scan.chunks.insert(0, scan.s.chunk(scan.loose[0][0], scan.loose[-1][1], "module", None, None))
    return scan.chunks, scan.symbols, scan.edges
