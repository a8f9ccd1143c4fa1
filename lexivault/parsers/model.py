"""What parsers give, and the scanning that several languages share."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Chunk:
    start_line: int
    end_line: int
    kind: str
    name: str | None
    scope: str | None
    text: str


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    line: int


@dataclass(frozen=True)
class Edge:
    target: str
    kind: str
    line: int
    meta: dict | None = None


def dotted(*parts: str | None) -> str | None:
    return ".".join(p for p in parts if p) or None


class Source:
    """A text with its lines, and ``code``: the same with comments and the insides of strings as spaces, so that offsets
    and line numbers agree."""

    def __init__(self, text: str, code: str):
        self.text, self.code = text, code
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.starts, at)

    def lines(self, first: int, last: int) -> str:
        end = self.starts[last] if last < len(self.starts) else len(self.text)
        return self.text[self.starts[first - 1] : end]

    def chunk(self, begin: int, end: int, kind: str, name: str | None, scope: str | None) -> Chunk:
        """The whole lines from offset ``begin`` to the one before ``end``."""
        first, last = self.line(begin), self.line(max(begin, end - 1))
        return Chunk(first, last, kind, name, scope, self.lines(first, last))


def blank(text: str, pattern: re.Pattern) -> str:
    """``text`` with all but line ends of each match of ``pattern`` as spaces; of a match's group ``keep``, the delimiters
    stay."""

    def out(m: re.Match) -> str:
        hidden = re.sub(r"[^\n]", " ", m[0])
        return m[0][0] + hidden[1:-1] + m[0][-1] if len(m[0]) > 1 and m[0][0] in "\"'`" and m[0][-1] == m[0][0] else hidden

    return pattern.sub(out, text)


OPEN, CLOSE = "([{", ")]}"


def closing(code: str, at: int, end: int | None = None) -> int:
    """Offset of the bracket that closes the one at ``at``; the end of the code without one."""
    depth = 0
    for k in range(at, len(code) if end is None else end):
        if code[k] in OPEN:
            depth += 1
        elif code[k] in CLOSE:
            depth -= 1
            if depth == 0:
                return k
    return (len(code) if end is None else end) - 1


def skip_space(code: str, at: int, end: int) -> int:
    while at < end and code[at].isspace():
        at += 1
    return at
