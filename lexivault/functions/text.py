"""Text functions as Spark columns: the index's tokenizer, glob and ignore patterns, line and excerpt projections."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCERPT_LINES = 30
CHAR_CAP = 8192
SIZE_CAP = 1 << 20
PROBE_BYTES = 8192


#: The combining marks that belong to the token that they stand in, and vanish; other marks part tokens.
VANISHING = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"


def folded(letter: str) -> str:
    """The simple case folding of one code point, whatever stands around it, and then the base letter of a Latin one with a
    single diacritic; letters with two, or without a decomposition (such as sharp s), stay."""
    out = next((x for x in (letter.casefold(), letter.lower()) if len(x) == 1), letter)
    if unicodedata.category(letter)[0] not in "LN" or "\uab70" <= letter <= "\uabbf" or "\u13f8" <= letter <= "\u13fd":  # marks; small letters that fold to capitals
        out = letter
    parts = unicodedata.normalize("NFD", out)
    return parts[0].lower() if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.combining(parts[1]) else out


@cache
def folding() -> tuple[str, str]:
    """All code points that change when folded, and what they become; last, without counterpart, the marks that vanish."""
    pairs = [(c, f) for c in map(chr, [*range(0x41, 0xD800), *range(0xF900, 0x11000)]) if (f := folded(c)) != c]
    return "".join(c for c, _ in pairs) + VANISHING, "".join(f for _, f in pairs)


def fold(text: Column) -> Column:
    """Lower case without diacritics, each code point by itself."""
    return F.translate(text, *folding())


@cache
def _table() -> dict:
    source, target = folding()
    return str.maketrans(source[: len(target)], target, VANISHING)


def fold_text(text: str) -> str:
    return text.translate(_table())


SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"


def tokens(text: Column) -> Column:
    """The index's tokens in order: runs of letters, numbers and private characters, folded. Null text has none."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), SEPARATORS), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    import regex

    return [t for t in regex.split(SEPARATORS, fold_text(text)) if t]


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a case-sensitive glob: ``*`` any run, ``?`` one character, both across ``/``;
    ``[...]`` a set, ``[^...]`` its complement; an unclosed set matches nothing."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            start = at + (pattern[at : at + 1] == "^")
            end = pattern.find("]", start + 1)
            if end < 0:
                return r"(?!)"
            body = re.sub(r"([\\\[\]&^~|])", r"\\\1", pattern[start:end])
            out.append("[" + ("^" if start > at else "") + body + "]")
            at = end + 1
        else:
            out.append(re.escape(c))
    return r"(?s)\A" + "".join(out) + r"\z"


def glob(path: Column, pattern: str) -> Column:
    """Whether ``path`` matches the glob. One that is a literal and a final ``*`` becomes a prefix test, which reaches the
    Parquet scan."""
    if not re.search(r"[*?\[]", pattern):
        return path == pattern
    if pattern.endswith("*") and not re.search(r"[*?\[]", pattern[:-1]):
        return path.startswith(pattern[:-1])
    return path.rlike(glob_regex(pattern))


def like_substring(column: Column, part: str) -> Column:
    """``LIKE '%part%'`` without an escape character: ``%`` and ``_`` in ``part`` are wild cards, a backslash is itself."""
    if "%" not in part and "_" not in part:
        return column.contains(part)
    return column.like("%" + part.replace("\\", "\\\\") + "%")


def ignore_regex(pattern: str) -> str | None:
    """Regular expression, over ``/``-separated paths relative to the pattern's folder, of a line of an ignore file; None
    for blank lines and comments. A path matches if it or a folder above it does."""
    line = pattern.rstrip("\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    line = line.removeprefix("!").removeprefix("\\") if line.startswith(("!", "\\")) else line
    only_folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.removeprefix("/")
    out, at = [], 0
    while at < len(line):
        if line.startswith("**/", at) and (at == 0 or line[at - 1] == "/"):
            out.append("(?:[^/]+/)*")
            at += 3
        elif line[at:] == "**" and (at == 0 or line[at - 1] == "/"):
            out.append(".+")
            at += 2
        elif line[at] == "*":
            out.append("[^/]*")
            at += 1
        elif line[at] == "?":
            out.append("[^/]")
            at += 1
        elif line[at] == "[" and "]" in line[at + 2 :]:
            end = line.index("]", at + 2)
            body = line[at + 1 : end]
            negate = body[:1] in "!^"
            out.append("[" + "^/" * negate + re.sub(r"([\\\[&~|])", r"\\\1", body[negate:]) + "]")
            at = end + 1
        else:
            if line[at] == "\\" and at + 1 < len(line):
                at += 1
            out.append(re.escape(line[at]))
            at += 1
    start = "^" if anchored else "(?:^|.*/)"
    return start + "".join(out) + ("/.*$" if only_folder else "(?:/.*)?$")


def ignored(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether the file ``path``, relative to the patterns' folder, is ignored. A later ``!`` line takes back earlier ones."""
    out = F.lit(False)
    for p in patterns:
        found = ignore_regex(p)
        if found is not None:
            out = F.when(path.rlike(found), F.lit(not p.startswith("!"))).otherwise(out)
    return out


#: Line ends of Python's ``splitlines``; a return and a newline are one.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def lines(text: Column) -> Column:
    """Lines without their ends; no empty one after a final line end, none for empty text."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def excerpt(text: Column, n: int = EXCERPT_LINES) -> Column:
    """The first ``n`` lines, joined by newlines."""
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, both from 1 and inclusive, with their newlines."""
    parts = F.split(text, "(?<=\n)", -1)
    parts = F.filter(parts, lambda p: p != "")
    return F.array_join(F.slice(parts, start, F.greatest(end - start + 1, F.lit(0))), "")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_binary(content: Column) -> Column:
    """Whether the first bytes hold a NUL."""
    return F.contains(F.substring(content, 1, PROBE_BYTES), F.lit(b"\x00"))


def scope_suffix(scope: Column, order: Column) -> Column:
    """``scope`` with a file's place in its project appended, where it has one."""
    return F.when(order.isNull(), scope).otherwise(F.concat(F.coalesce(scope, F.lit("")), F.lit("|fsproj="), order.cast("string")))
