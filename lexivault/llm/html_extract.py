"""Main-text extraction from HTML by tag-path ratios.

A page is cut into blocks of text, each with its tag path from the root. Text length, punctuation and link text are
summed by path; a path's ratio grows with its mean text length (``L / (L + HALF)``, so that one very long block doesn't
dwarf the others) and its mean punctuation and falls with its share of link text. A path below an element whose class,
id or role tells of adverts, notices, comments or the like has its ratio divided by ``HINTED`` for each such element; one
below ``article`` or ``main`` has it times ``NAMED``. Blocks in page order get their path's ratio, the series is smoothed,
raw and smoothed values are fused by their geometric mean, and blocks whose value reaches ``SHARE`` of the page's largest
are seeds.

The content container is the deepest ``article`` or ``main`` that holds all seeds, else, if such elements hold most of the
seeds' text, their deepest common ancestor, else that of all seeds. Of its blocks the seeds are content, and so are those
of elements made for prose (paragraphs, headings, list entries, cells, captions, quotations), unless a hint between the
container and the block lowers their path, or, outside ``article`` and ``main``, their path is mostly link text. The
page's only ``h1`` before a container without one is its title. Text in elements that never hold an article's
(navigation, scripts ...) takes no part.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from ._shared import beside

#: A comment may be empty or end with an exclamation mark, as browsers have it; to HTML a CDATA section is a declaration that
#: ends at the next ``>``. A quote opens a value only after ``=``, and only where it closes before white space or the tag's end; a tag whose
#: quotes don't match ends at the next ``>``.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')(?=[\s/>])|[^>])*+)(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؟]")

#: Elements whose content is no markup; the second kind is read as markup where its end is missing.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
MAYBE_RAW = frozenset("noscript iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand within a line of text; all others begin and end blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Elements whose text is never an article's; ``header`` is one outside ``article`` and ``main``.
NEVER = frozenset("nav header footer aside menu dialog button select option head template svg canvas object audio video".split())
#: Words of class, id or role that mark such parts.
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments discussion disqus replies reply complementary".split())
#: These mark them too, but not beside a word of the article: ``article-header``.
WEAK_HINTS = frozenset("header footer masthead banner notice notices alert contentinfo".split())
OF_ARTICLE = frozenset("article post entry story content".split())
#: A name of several words tells what its last one says (``share-price``), unless that only says of what kind the part is.
KINDS = frozenset("area articles banner bar block blocks body bottom box boxes btn button buttons card cards col column container content cta field footer form frame group header holder icon icons inner item items left link links list main module news outer panel panels posts region right row section sections site slot slots space stories strip tag text thread title top unit units widget widgets wrap wrapper zone".split())
#: As the ``id`` of a section these are places that links lead to.
PLACES = frozenset("discussion search login signup share sharing social related menu navigation promo subscribe recommended replies reply".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Classes of articles that aren't ``article`` elements.
POSTED = frozenset("article post entry story hentry".split())
#: Beside one of these a hint tells of the page's layout, not of the element: ``has-sidebar``.
NO_HINT = frozenset("has with no without".split())
#: Elements made for prose, and those of them that keep their links anywhere.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre summary address".split())
LINKED = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: An open element on the left ends where one on the right begins.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "option": frozenset(["option", "optgroup"]),
}
#: An end tag within one of these doesn't close what is open around it, unless it is of a table's own.
SCOPES = frozenset("td th caption table".split())
OF_TABLES = frozenset("td th caption table tr tbody thead tfoot body html".split())
#: Mean length at which a path's ratio is half of the most; factors of a hint and of ``article`` and ``main``; the share of
#: the largest value from which blocks are seeds.
HALF, HINTED, NAMED, SHARE = 80, 1000.0, 2.0, 0.2


class Node:
    """An element: ``number`` in page order, ``last`` the largest number within it, ``path`` the number of its tag path,
    ``out`` if its text is never an article's, ``inside`` an ``article`` or ``main``, ``level`` the hints around it, ``prose`` the
    nearest element made for prose from itself on up, ``posted`` if it or one around it is an article by its class."""

    __slots__ = ("number", "last", "name", "parent", "path", "hint", "out", "inside", "level", "prose", "posted")

    def __init__(self, number: int, name: str, parent: Node | None, path: int, hint: bool, out: bool, inside: bool):
        self.number, self.name, self.parent, self.path, self.hint, self.out, self.inside = number, name, parent, path, hint, out, inside
        self.last, self.level = number, 0
        self.prose: Node | None = self if name in PROSE else parent and parent.prose
        self.posted = parent is not None and parent.posted

    def holds(self, other: Node) -> bool:
        return self.number <= other.number <= self.last


@dataclass
class Block:
    """``node``: the element that the text stands in; ``text``: white space already folded; ``links``: characters of it in
    links."""

    node: Node
    text: str
    links: int

    @property
    def names(self) -> tuple[str, ...]:
        """The tag path from the root."""
        found, node = [], self.node
        while node.parent is not None:
            found.append(node.name)
            node = node.parent
        return tuple(reversed(found))


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order. Tags that are cut off by the page's end, unknown end tags and markup
    declarations vanish; an element that is never closed reaches to its parent's end or the page's."""
    found: list[Block] = []
    root = Node(0, "", None, 0, False, False, False)
    nodes, stack, open_names = [root], [root], Counter()
    paths: dict[tuple[int, str], int] = {}
    endless: set[str] = set()
    parts: list[str] = []
    links = 0
    in_link = False
    muted: list[str] = []  # open inline elements from a hinted one on
    muted_in: Node | None = None
    at = 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(stack[-1], text, links))
            parts = []
        links = 0

    def say(text: str) -> None:
        nonlocal links
        if muted:
            return
        text = _html.unescape(text)
        parts.append(text)
        if in_link:
            links += len(text.strip())

    def pop() -> Node:
        nonlocal muted_in
        node = stack.pop()
        node.last = len(nodes) - 1
        open_names[node.name] -= 1
        if node is muted_in:
            muted.clear()
            muted_in = None
        return node

    while at < len(page):
        open_at = page.find("<", at)
        if open_at < 0:
            say(page[at:])
            break
        if open_at > at:
            say(page[at:open_at])
        m = _TOKEN.match(page, open_at)
        if m is None:
            if re.match(r"</?[a-zA-Z]|<[!?]", page[open_at : open_at + 3]):
                break  # a tag that the page's end cuts off
            say("<")
            at = open_at + 1
            continue
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = not closing
            if name in VOID:
                continue
            if muted:
                if not closing:
                    if name == "a" and "a" in muted:  # links don't nest: the open one ends
                        del muted[muted.index("a") :]
                    else:
                        muted.append(name)
                elif name in muted:
                    while muted.pop() != name:
                        pass
                if not muted:
                    muted_in = None
            if not muted and not closing and attributes and _hinted(attributes):
                muted, muted_in = [name], stack[-1]
            continue
        if not closing:
            flush()
            in_link = False
            while stack[-1].name in CLOSED_BY and name in CLOSED_BY[stack[-1].name]:
                pop()
            if name in RAW:
                end = None if name in endless else re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                if end is not None:
                    close = page.find(">", end.start())
                    at = len(page) if close < 0 else close + 1
                    continue
                if name not in MAYBE_RAW:
                    break
                endless.add(name)
            if name in VOID or attributes.endswith("/") and name not in ("p", "div"):
                continue
            around = stack[-1]
            out = around.out or bool(muted) or name in NEVER and not (name == "header" and (around.inside or around.posted))
            hint = name == "form" or name not in ("html", "body") and bool(attributes) and _hinted(attributes, name)
            node = Node(len(nodes), name, around, paths.setdefault((around.path, name), len(paths) + 1), hint, out, around.inside or name in ("article", "main"))
            node.posted |= bool(attributes) and name in ("div", "section") and not hint and _posted(attributes)
            nodes.append(node)
            stack.append(node)
            open_names[name] += 1
            continue
        if name in ("html", "body") or not open_names[name]:
            flush()
            continue
        if name not in OF_TABLES:
            k = len(stack) - 1
            while stack[k].name != name and stack[k].name not in SCOPES:
                k -= 1
            if stack[k].name != name:
                flush()
                continue
        flush()
        in_link = False
        while pop().name != name:
            pass
    flush()
    while len(stack) > 1:
        pop()
    root.last = len(nodes) - 1
    _levels(nodes, found)
    return found


def _levels(nodes: list[Node], found: list[Block]) -> None:
    """Counts the hints around each element. An element that holds most of the page's text and an ``article``, ``main``
    or ``h1`` without a hint of its own is the page's wrapper, whatever its class says."""
    text, titled = [0] * len(nodes), [n.name in ("article", "main", "h1") and not n.hint and not n.out for n in nodes]
    for b in found:
        if not b.node.out:
            text[b.node.number] += len(b.text)
    for n in reversed(nodes[1:]):
        text[n.parent.number] += text[n.number]
        titled[n.parent.number] |= titled[n.number]
    for n in nodes[1:]:
        n.level = n.parent.level + (n.hint and not (titled[n.number] and 2 * text[n.number] > text[0]))


def _hinted(attributes: str, name: str = "") -> bool:
    """Whether an element's class, id or role says that it isn't of the article. Ids of headings, and some of sections, are
    places that links lead to and say nothing."""
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("class", "id", "role") and not (key == "id" and name in HEADINGS):
            tokens = [[p.lower() for p in _PART.findall(token) if not p.isdigit()] for token in value.strip("\"'").split()]
            of_article = any(not OF_ARTICLE.isdisjoint(parts) for parts in tokens)
            for parts in tokens:
                hints = HINTS - PLACES if key == "id" and name == "section" else HINTS
                if parts and NO_HINT.isdisjoint(parts):
                    weak = WEAK_HINTS if not of_article else frozenset()
                    if (parts[-1] in hints or parts[-1] in weak) or parts[-1] in KINDS and not (hints.isdisjoint(parts) and weak.isdisjoint(parts)):
                        return True
        if key == "hidden":
            return True
    return False


def _posted(attributes: str) -> bool:
    """Whether an element's class says that it is an article."""
    return any(key.lower() == "class" and any({p.lower() for p in _PART.findall(token)} <= POSTED for token in value.strip("\"'").split()) for key, value in _ATTRIBUTE.findall(attributes))


def ratios(found: list[Block]) -> list[float]:
    """The fused tag-path ratio of each block."""
    keys = [(b.node.path, b.node.level) for b in found]
    sums: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for key, b in zip(keys, found):
        s = sums[key]
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(_PUNCTUATION.findall(b.text))
        s[3] += b.links
    raw = []
    for key, b in zip(keys, found):
        n, length, marks, links = sums[key]
        mean = length / n
        prior = (NAMED if b.node.inside else 1.0) / HINTED ** min(key[1], 20)
        raw.append(mean / (mean + HALF) * (1 + min(marks / n, 4.0)) * max(0.0, 1 - links / length) * prior)
    smooth = [(raw[max(0, k - 1)] + 2 * raw[k] + raw[min(len(raw) - 1, k + 1)]) / 4 for k in range(len(raw))]
    return [(a * b) ** 0.5 for a, b in zip(raw, smooth)]


def content(found: list[Block]) -> list[Block]:
    """The content blocks of a page's blocks, in order."""
    found = [b for b in found if not b.node.out]
    if not found:
        return []
    value = ratios(found)
    bound = SHARE * max(value)
    seeds = [k for k, v in enumerate(value) if v >= bound and v > 0] or list(range(len(found)))
    # seeds in an article or main stand for the content where they are most of it
    named = [k for k in seeds if found[k].node.inside]
    if 2 * sum(len(found[k].text) for k in named) > sum(len(found[k].text) for k in seeds):
        seeds = named
    # numbers are in page order: what holds the smallest and the largest holds all between
    places = [found[k].node for k in seeds]
    low, high = min(places, key=lambda n: n.number), max(places, key=lambda n: n.number)
    shared = low
    while not shared.holds(high):
        shared = shared.parent
    container = shared
    while container.name not in ("article", "main", ""):
        container = container.parent
    if not container.name:
        container = shared
        while container.name in PROSE:
            container = container.parent
    passed, level = set(seeds), container.level
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for b in found:
        if container.holds(b.node):
            sums[b.node.path][0] += b.links
            sums[b.node.path][1] += len(b.text)
    own = []
    for k, b in enumerate(found):
        if container.holds(b.node) and b.node.level == level:
            links, length = sums[b.node.path]
            lists = 2 * links > length and not b.node.inside and b.node.name not in LINKED
            if not lists and (k in passed or value[k] >= bound or b.node.name in PROSE or _prose_around(b.node, container)):
                own.append(b)
    titles = [b for b in found if b.node.name == "h1" and not b.node.level]
    if len(titles) == 1 and not container.holds(titles[0].node) and titles[0].node.number < container.number:
        own = titles + own
    return own


def _prose_around(node: Node, container: Node) -> bool:
    """Whether an element made for prose stands between a block and the container: a ``div`` in a list entry."""
    return node.prose is not None and node.prose is not container and container.holds(node.prose)


def main_text(page: str | None) -> str:
    """The page's main text: its content blocks in order, one space between them. Empty for null, empty and pages
    without such a block."""
    return " ".join(b.text for b in content(blocks(page or "")))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (its code points) of every row. Null pages are empty; rows with equal or
    null keys stay apart; other columns are ignored, whatever their names."""
    ship(pages.sparkSession)
    given, kept = beside(pages, keep, F.coalesce(F.col(html_col), F.lit("")))
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 200
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                texts = [main_text(v.as_py()) for v in part.column(part.num_columns - 1)]
                columns = [part.column(k) for k in range(len(kept))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return given.mapInArrow(run, schema)


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
