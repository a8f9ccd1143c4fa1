from __future__ import annotations

import re

import pytest

from lexivault.llm import license_scan as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text: str):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    places = [(k, label) for phrase, label in S.BASE for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p]
    return len(words), sorted(places)


TEXTS = ["", "cc by cc by CC-BY", "All Rights Reserved. all rights, reserved", "general public license", "GNU General Public License, version 3", "all rights", "éall rights reservedé", "日本 CC BY 日本", "cc\x00by", "cc_by {cc by}", "a" * 1000]


@pytest.mark.parametrize("text", TEXTS)
def test_base_places(text):
    n, found, _ = S.Scanner().scan(text.encode())
    assert (n, sorted((k, label) for k, _, label in found)) == brute(text)


def test_templates():
    scan = lambda t: [(k, n, label) for k, n, label in S.Scanner().scan(t.encode())[2]]
    assert scan("x Released under the MIT License. y") == [(1, 5, "mit")]
    assert scan("Licensed under the Apache License, Version 2.0.") == [(0, 8, "apache-2.0")]
    assert scan("apache license 1.1") == []
    assert scan("This work is licensed under the GNU General Public License, version 3.") == [(0, 12, "gpl-3.0")]
    assert scan("Licensed under CC BY-NC 4.0.") == [(0, 7, "cc-by-nc")]
    assert scan("mit licence") == []


def test_automaton_regions():
    a = S.compile_template("t", "start [[maybe [[deep]] | other]] {{who:1-2}} end")
    accepts = lambda t: a.longest(t.encode().split(), 0) == len(t.split())
    for good in ("start a end", "start a b end", "start maybe a end", "start maybe deep a b end", "start other x end"):
        assert accepts(good), good
    for bad in ("start end", "start a b c d end", "start deep deep deep end", "begin a end", "start a b stop"):
        assert not accepts(bad), bad
    for wrong in ("[[a", "a]]", "[[only optional]]"):
        with pytest.raises(ValueError):
            S.compile_template("t", wrong)


def test_edges(spark, docs, no_docs):
    rows = S.scan_licenses(docs, "doc_id", "text").collect()
    assert len(rows) == 12
    for r in rows:
        assert (r.first_word is None) == (r.n_base == 0) and 0 <= r.score <= 1
    assert {r.n_words for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert S.scan_licenses(no_docs, "doc_id", "text").collect() == []


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in S.op4_license_scan(spark, d).collect():
        n, places = brute(texts[r.doc_id] or "")
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(at, default=None), max(at, default=None))
        own = sorted({label for _, label in places})
        assert r.base_labels == ",".join(own) and set(own) <= set(r.labels.split(","))


def labels(text):
    return {label for _, _, label in S.Scanner().scan(text.encode())[2]}


def filled(label, holder="the authors or copyright holders"):
    """A text that a label's first template accepts: all regions left out, each first wording, and a holder's name."""
    text = next(t for name, _, t in S.TEMPLATES if name == label)
    while "[[" in text:
        text = re.sub(r"\[\[[^\[\]]*\]\]", "", text)
    while "((" in text:
        text = re.sub(r"\(\(([^()|]*)\|[^()]*\)\)", r"\1", text)
    return re.sub(r"\{\{\w+:\d+-\d+\}\}", holder, text)


@pytest.mark.parametrize("label", ["mit", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense"])
def test_whole_licenses(label):
    text = "Copyright (c) 2024 Someone.\n" + filled(label).capitalize() + ".\n"
    assert label in labels(text)
    # every mandatory word counts: one that is changed or left out, anywhere, and the text isn't accepted
    words = filled(label).split()
    fixed = [k for k, w in enumerate(words) if w not in "the authors or copyright holders".split()]
    for k in fixed[:: max(1, len(fixed) // 25)]:
        assert label not in labels(" ".join(words[:k] + ["altered"] + words[k + 1 :]))
        assert label not in labels(" ".join(words[:k] + words[k + 1 :]))


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Released under GNU GPL v3.", "gpl-3.0"), ("the GNU General Public License v3", "gpl-3.0"), ("GPLv2", "gpl-2.0"), ("GPL-2.0-or-later", "gpl-2.0"), ("BSD 3-Clause License", "bsd-3-clause"),
        ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("Creative Commons Attribution 4.0 International", "cc-by-4.0"), ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0"),
    ],
)
def test_names_and_notices(text, label):
    assert label in labels(text)


def test_every_template_has_its_anchor():
    for label, anchor, text in S.TEMPLATES:
        bare = text
        while "[[" in bare:
            bare = re.sub(r"\[\[[^\[\]]*\]\]", "", bare)
        assert f" {anchor} " in f" {' '.join(bare.split())} ", (label, anchor)
        S.compile_template(label, text)


def as_pattern(template):
    """The template as a regular expression over words with a space after each."""
    out = []
    for m in S._MARK.finditer(template):
        mark = m[0]
        out.append({"[[": "(?:", "]]": ")?", "((": "(?:", "))": ")", "|": "|"}.get(mark) or (rf"(?:\S+ ){{{m[1]},{m[2]}}}" if m[1] else re.escape(mark) + " "))
    return re.compile("".join(out))


@pytest.mark.parametrize("template", ["a [[b [[c]] | d]] {{x:1-2}} e", "(( a | b c | [[d]] e )) f [[g]]", "{{x:0-2}} a (( b | b b )) [[c]]", "a (( [[b]] c | {{x:1-3}} d )) [[a]] e"])
def test_acceptor_against_brute_force(template):
    import random

    r, automaton, pattern = random.Random(5), S.compile_template("t", template), as_pattern(template)
    for _ in range(400):
        words = [r.choice("abcdefgh") for _ in range(r.randrange(1, 9))]
        for at in range(len(words)):
            true = max((end - at for end in range(at + 1, len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[at:end]))), default=0)
            assert automaton.longest([w.encode() for w in words], at) == true, (words, at)


def test_template_labels_of_the_query_against_patterns(spark):
    """Labels of whole documents by the automata and by plain patterns over all words."""
    patterns = [(label, re.compile(r"(?:^|(?<= ))" + as_pattern(text).pattern)) for label, _, text in S.TEMPLATES if "{{" not in text or len(text) < 200]
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in S.op4_license_scan(spark, d).collect():
        words = "".join(w + " " for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")))
        plain = {label for label, p in patterns if p.search(words)}
        assert plain <= set(r.labels.split(",")) and set(filter(None, r.labels.split(","))) - plain <= {label for _, label in S.BASE} | {"mit", "apache-2.0", "lgpl", "agpl", "gpl-2.0", "gpl-3.0", "mpl-2.0", "zlib", "isc", "bsd-2-clause", "bsd-3-clause"}


def test_many_places_take_time_in_proportion():
    import time

    def seconds(n):
        began = time.perf_counter()
        assert len(S.Scanner().scan(b"cc by " * n)[1]) == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(160_000) < 12 * max(seconds(40_000), 0.02)
