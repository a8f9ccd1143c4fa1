"""JavaScript and TypeScript, by top-level statements over text without comments and strings."""

from __future__ import annotations

import re

from .model import Chunk, Edge, Source, Symbol, closing, dotted, skip_space

_NAME = r"[A-Za-z_$][\w$]*"
_ASIDE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
#: A line that ends, or a next one that begins, with one of these isn't at its statement's end.
_GOES_ON = re.compile(r"(?:[-+*/%=&|^<>?:,.!~(\[{]|\b(?:extends|implements|in|of|instanceof|typeof|new|from|as|return|default|export|const|let|var|function|class))\s*\Z")
_GOES_ON_NEXT = re.compile(r"\s*(?:[.,?:*/%&|^=<>)\]}]|[-+](?![-+])|instanceof\b|in\b|of\b|as\b|from\b|extends\b|implements\b|else\b|catch\b|finally\b|while\b(?=.*;))")
_BLOCK = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\b|class\b|interface\b|enum\b|const\s+enum\b|namespace\b|module\b|if\b|for\b|while\b|do\b|try\b|switch\b|\{{|{_NAME}\s*:\s*(?:for|while|\{{))")


def blanked(text: str) -> str:
    """``text`` with comments, strings, templates and regular expressions as spaces between their delimiters."""
    out, at = list(text), 0

    def hide(a: int, b: int) -> None:
        for k in range(a, min(b, len(text))):
            if text[k] != "\n":
                out[k] = " "

    def template(at: int) -> int:
        k = at + 1
        while k < len(text) and text[k] != "`":
            if text[k] == "\\":
                k += 1
            elif text.startswith("${", k):
                depth, k = 1, k + 2
                while k < len(text) and depth:
                    if text[k] == "`":
                        k = template(k)
                    depth += (text[k : k + 1] == "{") - (text[k : k + 1] == "}")
                    k += 1
                continue
            k += 1
        return k

    while at < len(text):
        c = text[at]
        if m := _ASIDE.match(text, at):
            inner = c in "\"'"
            hide(at + inner, m.end() - inner)
            at = m.end()
        elif c == "`":
            end = template(at)
            hide(at + 1, end)
            at = end + 1
        elif c == "/" and (not (before := "".join(out[max(0, at - 40) : at]).rstrip()) or before[-1] in "(,=:[!&|?{};+-*%<>~^\n" or re.search(r"\b(?:return|typeof|case|in|of)\Z", before)):
            m = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*").match(text, at)
            if m:
                hide(at + 1, m.end() - 1)
            at = m.end() if m else at + 1
        else:
            at += 1
    return "".join(out)


def statements(code: str, at: int, end: int):
    """``(begin, stop)`` of each statement between two offsets."""
    while (at := skip_space(code, at, end)) < end:
        if code[at] in ";,}":
            at += 1
            continue
        block = _BLOCK.match(code, at, end)
        k = at
        while k < end:
            c = code[k]
            if c in "([{":
                own = c == "{" and block and not re.search(r"=\s*\Z|=>\s*\Z", code[at:k])
                k = closing(code, k, end) + 1
                if own and not _GOES_ON_NEXT.match(code, k, end) and not re.match(r"\s*\{", code[k:end]):
                    break
                continue
            if c == ";":
                k += 1
                break
            if c == "\n" and not _GOES_ON.search(code[at:k]) and not _GOES_ON_NEXT.match(code, k, end) and not (block and not re.search(r"[;{]", code[at:k]) and "(" in code[at:k] and re.match(r"\s*\{", code[k:end])):
                break
            k += 1
        stop = k
        while stop > at and code[stop - 1].isspace():
            stop -= 1
        yield at, stop
        at = max(k, at + 1)


_EXPORT = re.compile(r"export\b(?:\s+(default)\b)?\s*")
_FUNCTION = re.compile(rf"(?:declare\s+)?(?:async\s+)?function\s*\*?\s*({_NAME})?")
_CLASS = re.compile(rf"(?:declare\s+)?(?:abstract\s+)?class\b\s*(?!extends\b|implements\b)({_NAME})?")
_LEXICAL = re.compile(r"(?:declare\s+)?(?:const|let|var)\s+(?!enum\b)")
_TYPED = re.compile(rf"(?:declare\s+)?(?:(interface)|(type)|(?:const\s+)?(enum)|(namespace|module))\s+({_NAME}(?:\.{_NAME})*)\s*(?=[<={{\s])")
_ARROW = re.compile(rf"(?:async\s+)?(?:{_NAME}\s*=>|(?:<[^=]*?>\s*)?\()")
_METHOD = re.compile(rf"(?:(?:public|private|protected|static|async|override|readonly|get|set|abstract|declare)\s+)*\*?\s*(#?{_NAME}|\[[^\]]*\])\s*(?:<[^(]*>\s*)?\(")


class _Scan:
    def __init__(self, path: str, text: str, typed: bool):
        self.s = Source(text, blanked(text))
        self.code = self.s.code
        self.typed = typed
        self.stem = re.sub(r"\.[^.]*\Z", "", path.replace("\\", "/").rsplit("/", 1)[-1])
        self.chunks: list[Chunk] = []
        self.symbols: list[Symbol] = []
        self.edges: list[Edge] = []
        self.rest: list[tuple[int, int]] = []

    def string(self, at: int) -> str | None:
        """The string whose opening quote is at ``at``."""
        quote = self.code[at : at + 1]
        if quote not in ("'", '"', "`") or not quote:
            return None
        end = self.code.find(quote, at + 1)
        return self.s.text[at + 1 : end] if end > 0 else None

    def declarators(self, at: int, end: int) -> list[tuple[int, str | None, int]]:
        """Offset, name (None for patterns) and the initializer's offset (-1 without) of a declaration's parts."""
        out = []
        while (at := skip_space(self.code, at, end)) < end and self.code[at] != ";":
            name = re.compile(_NAME).match(self.code, at, end)
            k, init, depth = at, -1, 0
            while k < end and not (self.code[k] in ",;" and depth <= 0):
                c = self.code[k]
                if c in "([{":
                    k = closing(self.code, k, end)
                elif c == "<" and init < 0:
                    depth += 1
                elif c == ">" and init < 0 and self.code[k - 1] != "=":
                    depth -= 1
                elif c == "=" and init < 0 and self.code[k : k + 2] not in ("==", "=>") and self.code[k - 1] not in "=!<>":
                    init = skip_space(self.code, k + 1, end)
                k += 1
            out.append((at, name[0] if name else None, init))
            at = k + 1
        return out

    def arrow(self, at: int, end: int) -> bool:
        m = _ARROW.match(self.code, at, end)
        if not m:
            return False
        if not m[0].endswith("("):
            return True
        after = closing(self.code, m.end() - 1, end) + 1
        return bool(re.compile(r"\s*(?::[^=;]*?)?=>").match(self.code, after, end))

    def require(self, at: int, end: int) -> str | None:
        m = re.compile(r"require\s*\(\s*").match(self.code, at, end)
        return self.string(m.end()) if m else None

    def class_(self, begin: int, stop: int, name: str | None, at: int, scope: str | None) -> None:
        self.chunks.append(self.s.chunk(begin, stop, "class", name, scope))
        brace = self.code.find("{", at, stop)
        if brace < 0:
            return
        k, end = brace + 1, closing(self.code, brace, stop)
        while (k := skip_space(self.code, k, end)) < end:
            if self.code[k] == "@":
                m = re.compile(rf"@{_NAME}(?:\.{_NAME})*\s*").match(self.code, k)
                k = closing(self.code, m.end()) + 1 if m and self.code[m.end() : m.end() + 1] == "(" else m.end() if m else k + 1
                continue
            m = _METHOD.match(self.code, k, end)
            if m:
                after = closing(self.code, m.end() - 1, end) + 1
                body = re.compile(r"\s*(?::[^{;=]*(?:\{[^{}]*\}[^{;=]*)?)?\s*\{").match(self.code, after, end)
                if body:
                    last = closing(self.code, body.end() - 1, end) + 1
                    self.chunks.append(self.s.chunk(k, last, "function", m[1], dotted(scope, name)))
                    k = last
                    continue
            while k < end and self.code[k] not in ";\n":
                k = closing(self.code, k, end) + 1 if self.code[k] in "([{" else k + 1
            k += 1

    def declaration(self, begin: int, stop: int, at: int, scope: str | None, exported: bool, default: bool) -> bool:
        """Chunks of a declaration at ``at`` whose statement is ``begin`` to ``stop``, and its symbol if it is exported at
        the top; whether it has chunks."""
        own = exported and not default and scope is None
        name_symbol = lambda m: self.symbols.append(Symbol(m[1], "def", self.s.line(m.start(1))))
        if m := _FUNCTION.match(self.code, at, stop):
            if own and m[1]:
                name_symbol(m)
            if m[1] or default:
                self.chunks.append(self.s.chunk(begin, stop, "function", m[1], scope))
                return True
            return False
        if m := _CLASS.match(self.code, at, stop):
            if own and m[1]:
                name_symbol(m)
            self.class_(begin, stop, m[1], m.end(), scope)
            return True
        if self.typed and (m := _TYPED.match(self.code, at, stop)):
            kind = "interface" if m[1] else "type" if m[2] else "enum" if m[3] else "namespace"
            if own:
                self.symbols.append(Symbol(m[5], "def", self.s.line(m.start(5))))
            self.chunks.append(self.s.chunk(begin, stop, kind, m[5], scope))
            if kind == "namespace" and (brace := self.code.find("{", m.end(), stop)) >= 0:
                inner = dotted(scope, m[5])
                for a, b in statements(self.code, brace + 1, closing(self.code, brace, stop)):
                    e = _EXPORT.match(self.code, a, b)
                    before = len(self.symbols)
                    self.declaration(a, b, e.end() if e else a, inner, False, False)
                    if exported and e:
                        found = re.compile(rf"(?:declare\s+|abstract\s+|async\s+)*(?:function\s*\*?|class|interface|type|enum|namespace|const|let|var)\s+({_NAME})").match(self.code, e.end(), b)
                        if found:
                            self.symbols.insert(before, Symbol(dotted(inner, found[1]), "def", self.s.line(found.start(1))))
            return True
        if m := _LEXICAL.match(self.code, at, stop):
            parts = self.declarators(m.end(), stop)
            if own:
                self.symbols += [Symbol(name, "def", self.s.line(k)) for k, name, _ in parts if name]
            kinds = ["arrow" if i >= 0 and self.arrow(i, stop) else "require" if i >= 0 and self.require(i, stop) is not None else None for _, _, i in parts]
            if kinds and all(kinds) and not (exported and "require" in kinds):
                self.chunks += [self.s.chunk(begin, stop, "function", name, scope) for (_, name, _), k in zip(parts, kinds) if k == "arrow"]
                return True
        return False

    def imports(self, begin: int, stop: int) -> bool:
        m = re.compile(r"import\b(?!\s*[.(])\s*(type\b(?!\s*(?:,|from\b)))?").match(self.code, begin, stop)
        if not m:
            return False
        quotes = [k for k in range(m.end(), stop) if self.code[k] in "'\""]
        target = self.string(quotes[0]) if quotes else None
        if target is None:
            return True
        clause = re.sub(r"\bfrom\s*\Z", "", self.code[m.end() : quotes[0]].rstrip())
        names = []
        outside = re.sub(r"\{[^}]*\}", " ", clause)
        if star := re.search(rf"\*\s*as\s+({_NAME})", outside):
            outside = outside.replace(star[0], " ")
        names += re.findall(_NAME, outside)
        if star:
            names.append(f"* as {star[1]}")
        for spec in (re.search(r"\{([^}]*)\}", clause) or ["", ""])[1].split(","):
            words = spec.split()
            if words[:1] == ["type"] and len(words) > 1 and words[1] != "as":
                words = words[1:]
            if words:
                names.append(words[0])
        meta: dict = {"names": names}
        if self.typed and m[1]:
            meta["type_only"] = True
        self.edges.append(Edge(target, "import", self.s.line(begin), meta))
        return True

    def requires(self, begin: int, stop: int) -> None:
        targets = []
        if m := _LEXICAL.match(self.code, begin, stop):
            targets = [self.require(i, stop) for _, _, i in self.declarators(m.end(), stop) if i >= 0]
        else:
            targets = [self.require(begin, stop)]
        self.edges += [Edge(t, "import", self.s.line(begin), {"names": [], "form": "require"}) for t in targets if t is not None]

    def run(self) -> None:
        for begin, stop in statements(self.code, 0, len(self.code)):
            if self.imports(begin, stop):
                continue
            self.requires(begin, stop)
            e = _EXPORT.match(self.code, begin, stop)
            at = e.end() if e else begin
            default = bool(e and e[1])
            if default:
                self.symbols.append(Symbol(f"default::{self.stem}", "def", self.s.line(e.start(1))))
            elif e and (m := re.compile(r"(?:type\s+)?\{([^}]*)\}").match(self.code, at, stop)):
                for spec in re.finditer(rf"({_NAME})(?:\s+as\s+({_NAME}))?", m[1]):
                    group = 2 if spec[2] else 1
                    self.symbols.append(Symbol(spec[group], "def", self.s.line(m.start(1) + spec.start(group))))
            done = self.declaration(begin, stop, at, None, bool(e), default)
            if not done and default and self.arrow(at, stop):
                self.chunks.append(self.s.chunk(begin, stop, "function", None, None))
                done = True
            if not done and not (not e and self.code.startswith("require", begin) and self.require(begin, stop) is not None):
                self.rest.append((begin, stop))
        if self.rest:
            self.chunks.append(self.s.chunk(self.rest[0][0], self.rest[-1][1], "module", None, None))
        self.chunks.sort(key=lambda c: (c.start_line, c.end_line))


def parse_javascript(path: str, text: str) -> tuple[list[Chunk], list[Symbol], list[Edge]]:
    scan = _Scan(path, text, typed=False)
    scan.run()
    return scan.chunks, scan.symbols, scan.edges


def parse_typescript(path: str, text: str) -> tuple[list[Chunk], list[Symbol], list[Edge]]:
    scan = _Scan(path, text, typed=True)
    scan.run()
    return scan.chunks, scan.symbols, scan.edges
