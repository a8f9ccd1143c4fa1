"""Chunks, symbols and edges of small sources in each language."""

from __future__ import annotations

import pytest

from lexivault.parsers import EXTENSIONS, LANGUAGES, load_extra, parse
from lexivault.parsers.registry import parse_files


def shown(path, language, text, order=None):
    p = parse(path, language, text, order)
    assert p.error is None
    return [(c.start_line, c.end_line, c.kind, c.name, c.scope) for c in p.chunks], [(s.name, s.kind, s.line) for s in p.symbols], [(e.target, e.kind, e.line, e.meta) for e in p.edges]


def test_python():
    text = '"""Doc."""\nimport os, sys as s\nfrom . import near\nfrom ..up import x, y\nLIMIT = 1\n\n@wrap\ndef f():\n    def g():\n        pass\n    return g\n\nclass A:\n    async def m(self):\n        pass\n\nif LIMIT:\n    def hidden(): pass\n'
    chunks, symbols, edges = shown("a.py", "python", text)
    assert chunks == [(1, 18, "module", None, None), (8, 11, "function", "f", None), (9, 10, "function", "g", "f"), (13, 15, "class", "A", None), (14, 15, "function", "m", "A")]
    assert symbols == [("f", "def", 8), ("f.g", "def", 9), ("A", "def", 13), ("A.m", "def", 14)]
    assert edges == [("os", "import", 2, None), ("sys", "import", 2, None), (".near", "import", 3, None), ("..up.x", "import", 4, None), ("..up.y", "import", 4, None)]
    assert parse("a.py", "python", text).chunks[2].text == "    def g():\n        pass\n"


def test_csharp():
    text = """using System;
using static System.Math;
using IO = System.IO;

Run("a; {");

namespace A.B
{
    [Attr("x{")]
    public class C : Base<int>
    {
        private int n = 3;
        public int P { get; set; } = 1;
        public C() : base() { }
        public T Get<T>(int a, string b = "(") where T : class
        {
            if (a > 1) { return default; }
            static int Twice(int y) => y * 2;
            return Twice(a);
        }
        public abstract void Later();
    }
    public record R(int X);
    interface I { void Q(); }
    enum E { A, B }
}
"""
    chunks, symbols, edges = shown("a.cs", "csharp", text)
    assert chunks == [
        (5, 5, "module", None, None), (9, 22, "class", "C", "A.B"), (14, 14, "function", "C", "A.B.C"), (15, 20, "function", "Get", "A.B.C"), (18, 18, "function", "Twice", "A.B.C.Get"),
        (21, 21, "function", "Later", "A.B.C"), (23, 23, "record", "R", "A.B"), (24, 24, "interface", "I", "A.B"), (24, 24, "function", "Q", "A.B.I"), (25, 25, "enum", "E", "A.B"),
    ]
    assert [s[0] for s in symbols] == ["A.B.C", "A.B.C.C", "A.B.C.Get", "A.B.C.Get.Twice", "A.B.C.Later", "A.B.R", "A.B.I", "A.B.I.Q", "A.B.E"]
    assert [e[0] for e in edges] == ["System", "System.Math", "System.IO"]


def test_javascript():
    text = """import a, { b as c, d } from "m";
import * as e from 'n';
const q = require("r");
let x = 1;
export const f = (y) => y + `}${x}`, g = async z => { return /[{]/.test(z); };
export class K extends L {
    static s = 1;
    async run(p = {}) { return 1; }
    get v() { return "}"; }
}
export { x as shown };
export default class { }
function plain() {}
"""
    chunks, symbols, edges = shown("src/mod.js", "javascript", text)
    assert chunks == [
        (4, 11, "module", None, None), (5, 5, "function", "f", None), (5, 5, "function", "g", None), (6, 10, "class", "K", None), (8, 8, "function", "run", "K"), (9, 9, "function", "v", "K"),
        (12, 12, "class", None, None), (13, 13, "function", "plain", None),
    ]
    assert symbols == [("f", "def", 5), ("g", "def", 5), ("K", "def", 6), ("shown", "def", 11), ("default::mod", "def", 12)]
    assert edges == [("m", "import", 1, {"names": ["a", "b", "d"]}), ("n", "import", 2, {"names": ["* as e"]}), ("r", "import", 3, {"names": [], "form": "require"})]


def test_typescript():
    text = """import type { T } from "t";
import { type U, V } from "u";
export interface I<A> { a: A; }
type Local = { x: number };
export enum E { One }
namespace N.M {
    export function f(a: string): void {}
    const hidden = 1;
    class C { m(): Map<string, { a: 1 }> { return null; } }
}
export const g = (a: number): number => a;
"""
    chunks, symbols, edges = shown("a.ts", "typescript", text)
    assert chunks == [
        (3, 3, "interface", "I", None), (4, 4, "type", "Local", None), (5, 5, "enum", "E", None), (6, 10, "namespace", "N.M", None), (7, 7, "function", "f", "N.M"), (9, 9, "class", "C", "N.M"),
        (9, 9, "function", "m", "N.M.C"), (11, 11, "function", "g", None),
    ]
    assert [s[0] for s in symbols] == ["I", "E", "g"]
    assert edges == [("t", "import", 1, {"names": ["T"], "type_only": True}), ("u", "import", 2, {"names": ["U", "V"]})]


def test_go():
    text = 'package p\n\nimport (\n\tf "fmt"\n\t"io"\n)\n\nvar s = `}\n`\n\ntype (\n\tA struct{}\n\tB int\n)\n\nfunc (a *A) M() string {\n\treturn "{"\n}\n\nfunc (l List[T]) G() {}\n\nfunc F(x int) (int, error) {\n\treturn x, nil\n}\n'
    chunks, symbols, edges = shown("a.go", "go", text)
    assert chunks == [(1, 1, "module", None, None), (8, 9, "module", None, None), (11, 14, "type", "A", None), (16, 18, "function", "M", "p.A"), (20, 20, "function", "G", "p"), (22, 24, "function", "F", None)]
    assert [s[0] for s in symbols] == ["p.A", "p.A.M", "p.G", "p.F"]
    assert edges == [("fmt", "import", 4, {"alias": "f"}), ("io", "import", 5, None)]


def test_fsharp():
    text = "namespace N\n\nopen System\n\nmodule M =\n    // let no = 1\n    type U =\n        | A\n        | B of int\n\n    let rec go x =\n        x\n"
    chunks, symbols, edges = shown("a.fs", "fsharp", text, 2)
    assert chunks == [(1, 3, "namespace", "N", "|fsproj=2"), (5, 12, "module", "M", "N|fsproj=2"), (7, 9, "type", "U", "N.M|fsproj=2"), (11, 12, "function", "go", "N.M|fsproj=2")]
    assert [s[0] for s in symbols] == ["N", "N.M", "N.M.U", "N.M.U.A", "N.M.U.B", "N.M.go"]
    assert edges == [("System", "import", 3, None)]
    assert shown("a.fs", "fsharp", text)[0][0][4] is None


def test_lsl_with_comments():
    text = '// first\ninteger n = 1; /* { */\nsay(string s) { llSay(0, s); }\ndefault\n{\n    touch(integer k)\n    {\n        llListen(n, "a,b", NULL_KEY, ""); // llEmail("no")\n        llHTTPRequest("http://x/,y", [], "");\n        unknown(1);\n    }\n}\n'
    chunks, symbols, edges = shown("a.lsl", "lsl", text)
    assert chunks == [(2, 2, "module", None, None), (3, 3, "function", "say", "global"), (4, 12, "state", "default", None), (6, 11, "event", "touch", "default")]
    assert symbols == [("n", "def", 2), ("say", "def", 3), ("default.touch", "def", 6), ("llSay", "ref", 3), ("llListen", "ref", 8), ("llHTTPRequest", "ref", 9)]
    assert edges == [("n", "listen", 8, None), ('"http://x/,y"', "http", 9, None)]
    assert parse("a.lsl", "lsl", text).chunks[0].text == "integer n = 1;"


@pytest.mark.parametrize("language", sorted(LANGUAGES))
def test_malformed_sources_never_raise(language):
    for bad in ("", "{", "}}}}", "((((", '"', "'", "`${", "/*", "class", "def f(", "namespace", "import", "export default", "type X =", "func (", "default {", "\0", "é" * 10, "using", "const = =>", "<<<<", "a" * 3000, "@\"", "let \n let"):
        assert parse("x", language, bad).error is None


def test_extra_language(spark, tmp_path):
    path = tmp_path / "toy.py"
    path.write_text("class L:\n    name = 'toy'\n    extensions = ('.toy',)\n    def chunk(self, path, text): return []\n    def symbols(self, path, text): raise ValueError('no')\n    def imports(self, path, text): return []\nLANGUAGE = L()\n")
    (found,) = load_extra(path)
    assert (found.name, found.extensions) == ("toy", (".toy",)) and ".toy" not in EXTENSIONS
    files = spark.createDataFrame([("a.toy", "toy", "x", 1.0, 1, None), ("b.py", "python", "def f(): pass", 1.0, 1, None)], "path string, language string, content string, mtime double, size long, project_order int")
    rows = {r.path: r for r in parse_files(files, [str(path)]).collect()}
    assert "ValueError" in rows["a.toy"].error and rows["b.py"].chunks[0].name == "f"
    (tmp_path / "none.py").write_text("x = 1")
    with pytest.raises(ValueError):
        load_extra(tmp_path / "none.py")
