"""Walking, building, syncing and the command line, over a small project."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest

from lexivault import cli
from lexivault.config import find_config, load_config, version_pin, write_skeleton
from lexivault.errors import IndexError_
from lexivault.functions.embedding import HashBackend, MappedBackend, from_config, resolve_device
from lexivault.plans.build import Tree, build, sync
from lexivault.sources.store import IndexStore, check_model
from lexivault.sources.walk import list_files, project_orders, walk

FILES = {
    "main.py": 'import os\n\n\ndef greet(name):\n    """Say hello when a dropped session comes back."""\n    return f"hello {name}"\n',
    "main.js": 'import { a } from "b";\nexport function greet() { return 1; }\n',
    "main.ts": "export interface Greeting { text: string }\n",
    "main.go": 'package main\n\nimport "fmt"\n\nfunc Greet() { fmt.Println("x") }\n',
    "main.cs": "namespace N { class G { void Greet() { } } }\n",
    "main.fs": "module Main\n\nlet greet x = x\n",
    "main.lsl": 'default { touch(integer n) { llListen(1, "", NULL_KEY, ""); } }\n',
    "p.fsproj": '<Project><ItemGroup><Compile Include="other.fs" /><Compile Include="main.fs" /></ItemGroup></Project>',
    "node_modules/x.js": "export const no = () => 1;\n",
    "notes.txt": "not code\n",
}


@pytest.fixture()
def project(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_walk(spark, project, tmp_path):
    (project / "big.py").write_text("#" * (1 << 20) + "#")
    (project / "nul.py").write_bytes(b"x = 1\0")
    (project / "bad.py").write_bytes(b"x = '\xff'\n")
    (project / "we ird+%41[x].py").write_text("y = 1\n")
    (project / "loop").symlink_to(project)
    (project / "gone.py").symlink_to(project / "nowhere.py")
    (project / "sub").mkdir()
    (project / "sub/gen.py").write_text("z = 1\n")
    (project / "sub/.gitignore").write_text("/gen.py\n")
    rows = {r.path: r for r in walk(spark, project).collect()}
    assert {"main.py", "bad.py", "we ird+%41[x].py", "sub/gen.py"} <= set(rows) and not {"nul.py", "big.py", "node_modules/x.js", "notes.txt", "gone.py"} & set(rows)
    assert rows["bad.py"].content == "x = '\ufffd'\n" and rows["bad.py"].decode_warning and not rows["main.py"].decode_warning
    assert rows["main.fs"].project_order == 1 and rows["main.py"].mtime == os.stat(project / "main.py").st_mtime
    (project / ".git").mkdir()  # ignore files count in a repository
    (project / ".gitignore").write_text("*.ts\n")
    assert {f.rel_path for f in list_files(project, ["main.g?"])}.isdisjoint({"sub/gen.py", "main.ts", "main.go"})
    assert {f.rel_path for f in list_files(project, roots=["sub"])} == set()
    assert project_orders(project / "none.fsproj") == {}


def dump(snapshot, name, *columns):
    return {tuple(r) for r in snapshot.table(name).select(*columns).collect()}


def test_build_and_sync(spark, project):
    store, tree, backend = IndexStore(spark, project / "docs/.helpers/index"), Tree(project), HashBackend(16)
    with pytest.raises(IndexError_):
        store.open()
    dry = build(store, tree, backend, dry_run=True)
    assert dry.files_walked == 7 and not store.exists()
    r = build(store, tree, backend)
    first = store.open()
    ids = {r[0] for r in dump(first, "chunks", "id")}
    assert r.chunks == len(ids) == first.table("embeddings").count() and ids == {r[0] for r in dump(first, "embeddings", "chunk_id")}
    assert r.symbols == first.table("symbols").count() and r.edges == first.table("edges").count() and first.table("files").count() == 7
    assert {c for c, in dump(first, "symbols", "chunk_id")} <= ids
    before = dump(first, "chunks", "id", "path")
    assert sync(store, tree, backend).unchanged == 7 and dump(store.open(), "chunks", "id", "path") == before

    (project / "main.py").write_text(FILES["main.py"] + "\n\ndef search_me():\n    pass\n")
    os.utime(project / "main.py", (2e9, 2e9))
    (project / "new.py").write_text("def fresh(): pass\n")
    (project / "main.go").unlink()
    s = sync(store, tree, backend)
    assert (s.added, s.changed, s.unchanged, s.removed) == (1, 1, 5, 1)
    now = store.open()
    after = dump(now, "chunks", "id", "path")
    assert {x for x in after if x[1] not in ("main.py", "new.py")} == {x for x in before if x[1] not in ("main.py", "main.go")}
    assert min(i for i, p in after if p in ("main.py", "new.py")) > max(i for i, _ in before)  # ids are never used again
    assert {("search_me",), ("fresh",)} <= dump(now, "symbols", "name") and not any(p == "main.go" for _, p in after)
    assert s.chunks_total == len(after) == now.table("postings").select("id").distinct().count()
    again = build(store, tree, backend)
    assert again.chunks == len(after) and min(i for i, in dump(store.open(), "chunks", "id")) > max(i for i, _ in after)


def test_a_file_that_fails_to_parse_keeps_its_rows(spark, project, tmp_path_factory):
    toy = tmp_path_factory.mktemp("x") / "toy.py"
    toy.write_text("from lexivault.parsers.model import Chunk\nclass L:\n    name='toy'\n    extensions=('.toy',)\n    def parse(self, path, text):\n        if 'bad' in text: raise ValueError('bad')\n        return [Chunk(1, 1, 'module', None, None, text)], [], []\nLANGUAGE = L()\n")
    (project / "a.toy").write_text("good")
    tree = Tree(project, extensions={".toy": "toy"}, extra=[str(toy)])
    store, backend = IndexStore(spark, project / "index"), HashBackend(8)
    assert build(store, tree, backend).chunks == 1
    (project / "a.toy").write_text("bad now")
    (project / "b.toy").write_text("bad too")
    s = sync(store, tree, backend)
    assert (s.added, s.changed, s.unchanged, s.removed, s.chunks_total) == (0, 0, 1, 0, 1)
    assert store.open().table("chunks").first().content == "good"


def test_sync_keeps_postings(spark, project):
    """After syncs the stored postings and statistics are those of the chunks, though only changed texts were read."""
    from lexivault.operators.lexical import corpus_stats, postings

    store, backend = IndexStore(spark, project / "index"), HashBackend(8)
    tree = Tree(project)
    build(store, tree, backend)
    for step in range(3):
        (project / f"new{step}.py").write_text(f"def made_{step}():\n    return 'word{step} again'\n")
        if step:
            (project / f"new{step - 1}.py").unlink()
        if step == 2:
            (project / "new2.py").write_text("def other():\n    return 1\n\n\ndef more():\n    return 2\n")
        sync(store, tree, backend)
        now = store.open()
        rows = lambda df: sorted(map(repr, (tuple(r) for r in df.select("term", "id", "dl", "content", "name", "scope").collect())))
        assert rows(now.table("postings")) == rows(postings(now.table("chunks")))
        a, b = now.table("stats").first(), corpus_stats(now.table("chunks")).first()
        assert a.n == b.n and a.avgdl == pytest.approx(b.avgdl)


def test_store_checks(spark, tmp_path):
    store = IndexStore(spark, tmp_path / "i")
    for name, text in (("1/_meta.json", '{"schema_version": "0"}'), ("_CURRENT", "1")):
        (tmp_path / "i" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "i" / name).write_text(text)
    with pytest.raises(IndexError_) as e:
        store.open()
    assert (e.value.kind, e.value.code) == ("index.schema_mismatch", 10)
    (tmp_path / "i/1/_meta.json").write_text("{")
    with pytest.raises(IndexError_) as e:
        store.open()
    assert e.value.kind == "index.unreadable"
    for meta, kind in (({"embed_model": "a", "embed_dim": "4"}, "index.embed_model_mismatch"), ({"embed_model": "b", "embed_dim": "5"}, "index.embed_dim_mismatch")):
        with pytest.raises(IndexError_) as e:
            check_model(meta, "b", 4)
        assert (e.value.kind, e.value.code) == (kind, 11)


def test_backends(spark):
    from pyspark.sql import functions as F

    b = HashBackend(32)
    assert b.encode([]).shape == (0, 32) and abs((b.encode(["hello world"]) ** 2).sum() - 1) < 1e-6
    rows = spark.createDataFrame([(k, f"text {k}" if k else None) for k in range(50)], "k int, t string").select("k", b.column(F.col("t"), 7).alias("v")).collect()
    assert all(list(r.v) == pytest.approx(b.encode([f"text {r.k}" if r.k else ""])[0].tolist()) for r in rows)
    assert MappedBackend({"a": [1.0, 0.0]}, 2).encode(["a", "z"]).tolist() == [[1.0, 0.0], [0.0, 0.0]]
    assert resolve_device("cpu") == "cpu" and from_config("hash", "hash:8", "cpu").dim == 8
    for bad in (lambda: resolve_device("tpu"), lambda: from_config("voyage", "x")):
        with pytest.raises(IndexError_):
            bad()


CONFIGS = [
    ("[index", "config.parse_error"), ("[other]\nx = 1", "config.missing_key"), ("[index]\nproject = 'x'", "config.missing_key"), ("[index]\nversion = 3", "config.missing_key"),
    ("[index]\nversion = 'junk'", "config.version_mismatch"), ("[index]\nversion = '>=99'", "config.version_mismatch"), ("[index]\nversion = '>=0'\nembed_backend = 'x'", "config.bad_enum"),
    ("[index]\nversion = '>=0'\nembed_model = ''", "config.model_backend_mismatch"), ("[index]\nversion = '>=0'\nproject = ''", "config.parse_error"), ("[index]\nversion = '>=0'\nroots = 'x'", "config.parse_error"),
    ("[index]\nversion = '>=0'\nroots = ['nowhere']", "config.bad_path"), ("[index]\nversion = '>=0'\nextra_languages = ['no.py']", "config.bad_path"), ("[index]\nversion = '>=0'\nlanguages = ['cobol']", "config.unknown_language"),
    ("[index]\nversion = '>=0'\nembed_batch_size = true", "config.parse_error"),
]


@pytest.mark.parametrize(("text", "kind"), CONFIGS)
def test_config_faults(tmp_path, text, kind):
    path = tmp_path / "docs/.helpers/config.toml"
    path.parent.mkdir(parents=True)
    path.write_text(text)
    with pytest.raises(IndexError_) as e:
        load_config(path)
    assert (e.value.kind, e.value.code) == (kind, 2)


def test_config(tmp_path, caplog):
    out = write_skeleton(tmp_path, "name")
    c = load_config(Path(out["config_path"]))
    assert (c.project, c.project_root, c.roots) == ("name", tmp_path.resolve(), ["."]) and find_config(tmp_path) == c.config_path
    with pytest.raises(IndexError_):
        write_skeleton(tmp_path)
    assert write_skeleton(tmp_path, force=True)["force_used"]
    c.config_path.write_text(f"[index]\nversion = '{version_pin()}'\nmystery = 1\nlanguages = ['python']\n")
    assert load_config(c.config_path).active() == {".py": "python"} and "mystery" in caplog.text
    assert version_pin("0.3.9") == ">=0.3,<0.5"


def run(capsys, *args, code=0):
    assert cli.main([*args, "--format", "json"]) == code
    return json.loads(capsys.readouterr().out)


def test_command_line(spark, project, monkeypatch, capsys):
    monkeypatch.chdir(project)
    assert run(capsys, "search", "x", code=12)["error"]["kind"] == "index.missing"
    assert run(capsys, "init", "--name", "demo")["project"] == "demo"
    assert run(capsys, "init", code=1)["error"]["code"] == 1
    assert run(capsys, "symbols", "defs", "x", code=12)["error"]["kind"] == "index.missing"
    assert run(capsys, "config", "show")["index"] is None
    assert run(capsys, "index", "build", "--dry-run")["chunks_inserted"] == 0
    built = run(capsys, "index", "build")
    assert built["files_walked"] == 7 and built["chunks_inserted"] == built["chunks_chunked"] > 7
    assert run(capsys, "index", "sync")["files_unchanged"] == 7
    found = run(capsys, "search", "hello", "--mode", "bm25")["results"]
    assert {r["name"] for r in found} == {"greet"} and found[0]["path"] == "main.py"
    assert run(capsys, "search", "dropped session", "--lang", "python", "--k", "1")["results"][0]["path"] == "main.py"
    assert run(capsys, "search", "zzz", "--mode", "bm25") == {"results": []}
    assert [(r["path"], r["name"]) for r in run(capsys, "symbols", "defs", "greet", "--exact")] == [("main.fs", "greet"), ("main.js", "greet"), ("main.py", "greet")]
    assert run(capsys, "symbols", "refs", "llListen")[0]["path"] == "main.lsl"
    assert run(capsys, "graph", "callers", "fmt")[0]["dst_name"] == "fmt"
    assert run(capsys, "graph", "deps", "main.js") == [{"path": "main.js", "kind": "import", "dst_name": "b", "meta": '{"names": ["a"]}'}]
    assert run(capsys, "config", "show")["index"]["embed_model"] == "hash:64"
    assert run(capsys, "index", "rebuild", code=1)["error"]["kind"] == "usage.confirmation_required"
    assert run(capsys, "index", "rebuild", "--yes")["chunks_inserted"] == built["chunks_inserted"]
    for args, code, kind in ((("search", "a-b"), 1, "usage.query_syntax"), (("search", "x", "--mode", "odd"), 1, "cli.bad_enum"), (("search", "x", "--lang", "cobol"), 1, "cli.bad_enum"), (("usage", "odd"), 1, "cli.bad_enum"), (("nope",), 1, "usage.bad_arguments")):
        assert run(capsys, *args, code=code)["error"]["kind"] == kind
    for topic in cli.TOPICS:
        assert run(capsys, "usage", topic)["topic"] == topic
    config = project / "docs/.helpers/config.toml"
    config.write_text(config.read_text().replace("hash:64", "hash:32"))
    assert run(capsys, "symbols", "defs", "x", code=11)["error"]["code"] == 11
    assert cli.main(["config", "show"]) == 0 and "[mismatch]" in capsys.readouterr().out
    assert cli.main(["search", "hello", "--mode", "bm25", "--verbose"]) == 0 and "score=" in capsys.readouterr().out
