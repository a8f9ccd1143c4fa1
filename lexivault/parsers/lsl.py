"""LSL, by brackets. Comments are blanked in place, so offsets, lines and texts agree."""

from __future__ import annotations

import re

from .model import Chunk, Edge, Source, Symbol, closing, skip_space

#: The language's events; fixed values.
EVENTS = frozenset(
    "state_entry state_exit touch_start touch touch_end collision_start collision collision_end land_collision_start land_collision land_collision_end timer listen sensor no_sensor control at_target not_at_target at_rot_target not_at_rot_target money email run_time_permissions changed attach dataserver moving_start moving_end object_rez remote_data http_response http_request link_message on_rez transaction_result path_update experience_permissions experience_permissions_denied".split()
)
TYPES = "integer|float|string|key|vector|rotation|list"
#: Calls that are edges, and their kinds; fixed values.
EDGE_CALLS = {"llListen": "listen", "llMessageLinked": "link_message", "llHTTPRequest": "http", "llEmail": "email"}
_PART = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\]|\\.)*(?:"|\Z)', re.S)
_CALL = re.compile(r"\b(ll[A-Z][A-Za-z0-9]*)\s*\(")
_GLOBAL = re.compile(rf"(?:{TYPES})\s+([A-Za-z_]\w*)\s*(?:=|;)")
_FUNCTION = re.compile(rf"(?:(?:{TYPES})\s+)?([A-Za-z_]\w*)\s*\(")
_STATE = re.compile(r"(?:state\s+([A-Za-z_]\w*)|(default))\s*\{")
_EVENT = re.compile(r"([a-z_]+)\s*\(")


def _blanked(text: str, strings: bool) -> str:
    hide = lambda m: re.sub(r"[^\n]", " ", m[0]) if strings or m[0][0] == "/" else m[0]
    return _PART.sub(hide, text)


def _slice(s: Source, begin: int, end: int, kind: str, name: str | None, scope: str | None) -> Chunk:
    return Chunk(s.line(begin), s.line(max(begin, end - 1)), kind, name, scope, s.text[begin:end])


def parse(path: str, text: str) -> tuple[list[Chunk], list[Symbol], list[Edge]]:
    s = Source(text, _blanked(text, strings=True))
    code, spoken = s.code, _blanked(text, strings=False)
    globals_, chunks, symbols = [], [], []
    at = 0
    while (at := skip_space(code, at, len(code))) < len(code):
        if m := _STATE.match(code, at):
            end = closing(code, m.end() - 1) + 1
            name = m[1] or m[2]
            chunks.append(_slice(s, at, end, "state", name, None))
            k = m.end()
            while (k := skip_space(code, k, end - 1)) < end - 1:
                if (e := _EVENT.match(code, k)) and e[1] in EVENTS:
                    brace = skip_space(code, closing(code, e.end() - 1) + 1, end)
                    if brace < end and code[brace] == "{":
                        stop = closing(code, brace) + 1
                        chunks.append(_slice(s, k, stop, "event", e[1], name))
                        symbols.append(Symbol(f"{name}.{e[1]}", "def", s.line(k)))
                        k = stop
                        continue
                k = closing(code, k) + 1 if code[k] in "({[" else k + len(re.match(r"\w+|.", code[k:], re.S)[0])
            at = end
        elif m := _GLOBAL.match(code, at):
            end = code.find(";", at) + 1 or len(code)
            globals_.append((at, end))
            symbols.append(Symbol(m[1], "def", s.line(at)))
            at = end
        elif m := _FUNCTION.match(code, at):
            brace = skip_space(code, closing(code, m.end() - 1) + 1, len(code))
            if brace < len(code) and code[brace] == "{":
                end = closing(code, brace) + 1
                chunks.append(_slice(s, at, end, "function", m[1], "global"))
                symbols.append(Symbol(m[1], "def", s.line(at)))
                at = end
            else:
                at = m.end()
        else:
            at += len(re.match(r"\w+|.", code[at:], re.S)[0])
    if globals_:
        chunks.insert(0, _slice(s, globals_[0][0], globals_[-1][1], "module", None, None))
    edges = []
    for m in _CALL.finditer(code):
        symbols.append(Symbol(m[1], "ref", s.line(m.start())))
        if m[1] in EDGE_CALLS:
            stop = closing(code, m.end() - 1)
            k, depth = m.end(), 0
            while k < stop and not (code[k] == "," and depth == 0):
                depth += (code[k] in "([{<") - (code[k] in ")]}>")
                k += 1
            if target := spoken[m.end() : k].strip():
                edges.append(Edge(target, EDGE_CALLS[m[1]], s.line(m.start())))
    return chunks, symbols, edges
