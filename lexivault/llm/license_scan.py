"""License scans by template-markup matching.

A template is a text with regions: ``[[ ... ]]`` may be left out, of ``(( ... | ... ))`` one wording must stand (regions
nest), and ``{{name:least-most}}`` stands for that many words of any kind, such as a holder's name. It is compiled to a token automaton: a state per mandatory or
optional word, transitions over words, and skips over optional regions. A text is accepted from a word on if the
mandatory words follow one another exactly as the template has them. Matching is over words, so case, punctuation
and line breaks don't count. Of the matches that begin at a word the longest is taken.

Scanning is one pass per text over its UTF-8 bytes: a 256-byte table folds A-Z and turns everything that is no word
character into a space. Only texts that contain a template's anchor (its rarest mandatory words) run automata.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

_byte = np.arange(256, dtype=np.uint8)
_is_word = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | ((_byte >= 0x41) & (_byte <= 0x5A)) | (_byte >= 0x80)
#: A-Z to a-z; 0-9, a-z and all bytes of multi-byte characters stay; the rest become spaces.
FOLD = np.where(_is_word, np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte), 0x20).astype(np.uint8).tobytes()

#: The contract's base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_AS_IS = "software is provided as is"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "[[3]] neither the name of {{holder:1-20}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this software is provided by {{holder:2-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{holder:2-12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
)
_GNU_NOTICE = "[[you can]] redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free software foundation (( either version {version} of the license or at your option any later version | version {version} of the license ))"
_V = "(( {0} [[0]] | v{0} [[0]] | v {0} [[0]] | version {0} [[0]] ))"

#: Label, anchor (words that every accepted text has), template. The wording is that of the licenses themselves, of the
#: notices that they ask for, and of their names and identifiers. A text whose mandatory words differ isn't accepted.
TEMPLATES = (
    # whole licenses
    (
        "mit",
        "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the "
        + _AS_IS
        + " without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{holder:2-20}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("bsd-2-clause", "redistribution and use in source and binary forms", f"{_BSD[0]} {_BSD[2]}"),
    ("bsd-3-clause", "redistribution and use in source and binary forms", f"{_BSD[0]} {_BSD[1]} {_BSD[2]}"),
    (
        "isc",
        "this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify [[and or | and | or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the "
        + _AS_IS
        + " and {{holder:1-8}} (( disclaims | disclaim )) all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{holder:1-8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose",
        "this software is provided as is without any express or implied warranty in no event will {{holder:1-8}} be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    ),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    # notices
    (
        "apache-2.0",
        "except in compliance with the license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{address:1-8}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl-2.0", "general public license as published", _GNU_NOTICE.format(kind="general", version="2")),
    ("gpl-3.0", "general public license as published", _GNU_NOTICE.format(kind="general", version="3")),
    ("lgpl", "public license as published", _GNU_NOTICE.format(kind="(( lesser | library )) general", version="(( 2 [[1]] | 3 ))")),
    ("agpl", "affero general public license as published", _GNU_NOTICE.format(kind="affero general", version="3")),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {{address:1-6}}"),
    # names
    ("mit", "mit license", "[[this software is]] [[released | licensed | distributed | available]] [[under]] [[the]] [[terms of the]] mit license"),
    ("apache-2.0", "apache license", "[[licensed under the]] [[the]] apache license [[version | v]] (( 2 0 | 2 | v2 [[0]] ))"),
    ("apache-2.0", "apache 2 0", "apache 2 0 [[license]]"),
    ("gpl-2.0", "general public license", "[[this {{work:1-4}} is licensed under the]] gnu general public license " + _V.format(2) + " [[of the license]] [[or at your option any later version]]"),
    ("gpl-3.0", "general public license", "[[this {{work:1-4}} is licensed under the]] gnu general public license " + _V.format(3) + " [[of the license]] [[or at your option any later version]]"),
    ("gpl-2.0", "gpl", "[[gnu]] gpl " + _V.format(2) + " [[only | or later]]"),
    ("gpl-3.0", "gpl", "[[gnu]] gpl " + _V.format(3) + " [[only | or later]]"),
    ("gpl-2.0", "gplv2", "[[gnu]] gplv2"),
    ("gpl-3.0", "gplv3", "[[gnu]] gplv3"),
    ("lgpl", "lesser general public license", "gnu lesser general public license [[version {{version:1-2}}]]"),
    ("lgpl", "lgpl", "[[gnu]] lgpl [[v]] [[2 1 | 3 0 | v2 1 | v3 [[0]] | 3]]"),
    ("agpl", "affero general public license", "gnu affero general public license [[version {{version:1-2}}]]"),
    ("agpl", "agpl", "[[gnu]] agpl [[v]] [[3 [[0]] | v3 [[0]]]]"),
    ("cc-by-4.0", "cc by 4 0", "[[licensed under]] [[a]] cc by 4 0 [[international]] [[license]]"),
    ("cc-by-4.0", "creative commons attribution 4 0", "creative commons attribution 4 0 [[international]] [[public]] [[license]]"),
    ("cc-by-sa", "cc by sa", "[[licensed under]] [[a]] cc by sa [[{{version:1-2}} international]] [[4 0]]"),
    ("cc-by-sa", "creative commons attribution", "creative commons attribution (( sharealike | share alike )) [[4 0 | 3 0]] [[international | unported]] [[public]] [[license]]"),
    ("cc-by-nc", "cc by nc", "[[licensed under]] [[a]] cc by nc [[sa | nd]] [[4 0]] [[international]] [[license]]"),
    ("cc-by-nc", "creative commons attribution", "creative commons attribution (( noncommercial | non commercial )) [[sharealike | share alike | noderivatives | noderivs]] [[4 0 | 3 0]] [[international | unported]] [[public]] [[license]]"),
    ("cc-by-nd", "cc by nd", "[[licensed under]] [[a]] cc by nd [[4 0]] [[international]] [[license]]"),
    ("cc-by-nd", "creative commons attribution", "creative commons attribution (( noderivatives | noderivs | no derivatives )) [[4 0 | 3 0]] [[international | unported]] [[public]] [[license]]"),
    ("cc0", "cc0", "cc0 [[1 0]] [[universal]]"),
    ("bsd", "bsd license", "[[released | licensed]] [[under the]] [[2 | 3]] [[clause]] bsd license"),
    ("bsd-2-clause", "bsd 2 clause", "bsd 2 clause [[license]]"),
    ("bsd-3-clause", "bsd 3 clause", "bsd 3 clause [[license]]"),
    ("mpl-2.0", "mozilla public license", "mozilla public license [[version]] [[v]] 2 0"),
    # identifiers, beside those that are names above
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("isc", "spdx license identifier isc", "spdx license identifier isc"),
    ("zlib", "spdx license identifier zlib", "spdx license identifier zlib"),
    ("mpl-2.0", "spdx license identifier mpl 2 0", "spdx license identifier mpl 2 0"),
    ("unlicense", "spdx license identifier unlicense", "spdx license identifier unlicense"),
)


@dataclass
class Automaton:
    """States are numbered; ``words[s]`` maps a word to next states, ``any[s]`` holds next states over any word,
    ``skips[s]`` those reached without one. The last state accepts."""

    label: str
    words: list[dict[bytes, list[int]]] = field(default_factory=lambda: [{}])
    any: list[list[int]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])

    def state(self) -> int:
        self.words.append({})
        self.any.append([])
        self.skips.append([])
        return len(self.words) - 1

    def closure(self, states: Iterator[int] | Sequence[int]) -> set[int]:
        found, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in found:
                found.add(s)
                todo += self.skips[s]
        return found

    def starts(self) -> set[bytes] | None:
        """Words that a match can begin with; None if any can."""
        first = self.closure([0])
        return None if any(self.any[s] for s in first) else {w for s in first for w in self.words[s]}

    def longest(self, text: Sequence[bytes], at: int) -> int:
        """Words of the longest match that begins at ``at``; 0 for none."""
        last, now, best = len(self.words) - 1, self.closure([0]), 0
        for k in range(at, len(text)):
            now = self.closure([n for s in now for n in (*self.words[s].get(text[k], ()), *self.any[s])])
            if not now:
                break
            if last in now:
                best = k - at + 1
        return best


_MARK = re.compile(r"\[\[|\]\]|\(\(|\)\)|\||\{\{\w+:(\d+)-(\d+)\}\}|[^\s\[\]|{}()]+")


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template. ``|`` in a region separates wordings. ValueError for unbalanced regions."""
    a = Automaton(label)
    at, open_regions = 0, []
    for m in _MARK.finditer(template):
        token = m[0]
        if token in ("[[", "(("):
            open_regions.append((at, [], token))
        elif token in ("|", "]]", "))"):
            if not open_regions or token != "|" and open_regions[-1][2] != {"]]": "[[", "))": "(("}[token]:
                raise ValueError(f"unbalanced region in the template of {label}")
            begin, ends, kind = open_regions[-1]
            ends.append(at)
            if token == "|":
                at = a.state()
                a.skips[begin].append(at)
            else:
                open_regions.pop()
                at = a.state()
                for s in {begin, *ends} if kind == "[[" else set(ends):
                    a.skips[s].append(at)
        elif m[1]:
            least, most = int(m[1]), int(m[2])
            passed = [at]
            for _ in range(most):
                n = a.state()
                a.any[at].append(n)
                at = n
                passed.append(at)
            end = a.state()
            for s in passed[least:]:
                a.skips[s].append(end)
            at = end
        else:
            for word in token.encode().translate(FOLD).split():
                n = a.state()
                a.words[at].setdefault(word, []).append(n)
                at = n
    if open_regions:
        raise ValueError(f"unbalanced region in the template of {label}")
    end = a.state()
    a.skips[at].append(end)
    if end in a.closure([0]):
        raise ValueError(f"the template of {label} accepts the empty text")
    return a


class Scanner:
    """The compiled templates and base phrases."""

    def __init__(self, templates: Sequence[tuple[str, str, str]] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE):
        self.base = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in base]
        self.compiled = [(b" " + anchor.encode() + b" ", compile_template(label, text)) for label, anchor, text in templates]
        self.compiled = [(anchor, a, a.starts()) for anchor, a in self.compiled]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Number of words, the places of base phrases and the matches of templates, as ``(first word, words, label)``."""
        words = text.translate(FOLD).split()
        joined = b" " + b" ".join(words) + b" "
        found, matches = [], []
        for phrase, n, label in self.base:
            at, counted, word = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", counted, at)  # words before this place, counted on from the last
                counted = at
                found.append((word, n, label))
                at = joined.find(phrase, at + 1)
        for anchor, automaton, starts in self.compiled:
            if anchor in joined:
                until = -1
                for k, word in enumerate(words):
                    if k >= until and (starts is None or word in starts) and (n := automaton.longest(words, k)):
                        matches.append((k, n, automaton.label))
                        until = k + n
        return len(words), found, matches


def scan_licenses(docs: DataFrame, id_col: str, text_col: str, templates: Sequence[tuple[str, str, str]] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """``<id_col>, n_words, n_base, first_word, last_word, base_labels, labels, score, matches`` of every row.

    ``score`` is the share of the text's words that base phrases and templates cover. ``matches`` holds each place as
    ``(start, words, label)``, words counted from 0. Null and empty texts have 0 words, empty labels and score 0.
    Rows with equal or null ids stay apart; other columns are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<start:long,words:long,label:string>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column(0), batch.column(1)):
                n, found, matches = scanner.scan(text.as_py())
                places = sorted({*found, *matches})
                covered, until = 0, 0
                for start, words, _ in places:
                    covered += max(0, start + words - max(start, until))
                    until = max(until, start + words)
                at = [p[0] for p in found]
                own = {p[2] for p in found}
                rows.append((ident.as_py(), n, len(found), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {p[2] for p in matches})), covered / n if n else 0.0, [{"start": s, "words": w, "label": label} for s, w, label in places]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    given = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    return given.mapInArrow(run, schema)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").drop("matches")
