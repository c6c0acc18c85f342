"""Globs, guards, configuration, workspace maps and snapshots."""

import json
import random
import re

import pytest

from millrace.cli import markdown, workspace_root, write_defaults
from millrace.schema import TABLES
from millrace.sources import tree
from millrace.sources.store import Store


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("**/dist/**", "dist/a.js", True), ("**/dist/**", "a/b/dist/c/d", True), ("**/dist/**", "distant/a", False), ("**/*.pyc", "a.pyc", True), ("**/*.min.js", "x/y.min.js", True), ("**/*.min.js", "x/y.js", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("**/.env*", "x/.env.local", True), ("a+b", "a+b", True)],
)
def test_globs(glob, path, hit):
    assert bool(re.match(tree.glob_regex(glob), path)) is hit


def test_excludes():
    got = tree.excluded_globs(["mine/**", "**/*.map"], ["# note", "", " theirs/** "])
    assert got[-2:] == ["mine/**", "theirs/**"] and len(got) == len(set(got))
    assert "**/*.egg-info/**" in tree.default_excludes({"setup.py"}) and "**/web_modules/**" not in tree.default_excludes({"setup.py"})


def test_guards(spark):
    rows = [("a.ts", 10), ("b.PNG", 10), ("big.ts", 11 * 1024 * 1024), ("edge.ts", 10 * 1024 * 1024), ("node_modules/x.ts", 1), (".hidden/x.ts", 1), ("x/yarn.lock", 1)]
    assert {r["path"] for r in tree.guarded(spark.createDataFrame(rows, "path string, length long")).collect()} == {"a.ts", "edge.ts"}
    assert {r["path"] for r in tree.guarded(spark.createDataFrame(rows, "path string, length long"), ["a*"]).collect()} == {"a.ts"}


def test_workspace_maps(spark):
    files = spark.createDataFrame([("packages/x/package.json", '{"name": "@a/x"}'), ("package.json", '{"name": "top"}'), ("deep/packages/y/package.json", '{"name": "no"}'), ("go.mod", "module m.org/z\n\ngo 1.2"), ("c/Cargo.toml", '[package]\nname = "my-crate"'), ("w/Cargo.toml", "[workspace]")], "path string, content string")
    held = tree.workspace(files)
    assert {tuple(r) for r in tree.packages(held).collect()} == {("@a/x", "packages/x"), ("top", "")}
    assert tree.go_module(held) == "m.org/z"
    assert {tuple(r) for r in tree.crates(held).collect()} == {("my-crate", "c"), ("my_crate", "c"), ("", "w")}


def test_scan_reads_awkward_files(spark, tmp_path):
    """Files of no bytes, of other encodings, with spaces and other letters in their names, and none of what is excluded."""
    for name, data in {"a.ts": b"x", "pkg/__init__.py": b"", "_lib/deep/_x.py": b"import os", "_lib/deep/y.py": b"z", "empty.ts": b"", "latin.py": "caf\u00e9".encode("latin-1"), "bom.ts": b"\xef\xbb\xbfimport './a'", "with space/\u00e9 %.ts": b"y", "node_modules/m/index.js": b"\xff", "node_modules/none.js": b"", "big.bin": b"1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: r for r in tree.scan(spark, str(tmp_path)).collect()}
    assert {p: r["content"] for p, r in got.items()} == {"a.ts": "x", "pkg/__init__.py": "", "_lib/deep/_x.py": "import os", "_lib/deep/y.py": "z", "empty.ts": "", "latin.py": "caf\ufffd", "bom.ts": "import './a'", "with space/\u00e9 %.ts": "y"}
    assert {p for p, r in got.items() if r["error"]} == {"latin.py"}
    only = tree.scan(spark, str(tmp_path), paths=spark.createDataFrame([("a.ts",), ("gone.ts",), ("empty.ts",)], "path string"))
    assert {r["path"] for r in only.collect()} == {"a.ts", "empty.ts"}


def test_ignore_file_of_many_lines(spark, tmp_path):
    (tmp_path / ".millraceignore").write_text("\n".join(f"x{i}/**" for i in range(12_000)))
    assert len(tree.ignore_lines(spark, str(tmp_path))) == 12_000


def test_configuration(spark, tmp_path):
    assert tree.config(spark, str(tmp_path)) == {} and tree.ignore_lines(spark, str(tmp_path)) == []
    (tmp_path / "go.mod").write_text("module m")
    write_defaults(str(tmp_path))
    assert "**/vendor/**" in tree.config(spark, str(tmp_path))["indexing"]["exclude"]
    (tmp_path / "millrace.config.json").write_text("{broken")
    assert tree.config(spark, str(tmp_path)) == {}
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert workspace_root(str(tmp_path / "a" / "b")) == str(tmp_path)


def test_snapshots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.read("tasks").count() == 0
    store.ensure()
    before = store.pointers()
    store.ensure()
    assert store.pointers() == before
    old = store.read("rules")
    store.write(rules=spark.createDataFrame([(1, "n", "d", "global", "", "info", None)], "id long, name string, description string, scope_type string, scope_value string, severity string, created_at timestamp"))
    assert store.read("rules").count() == 1 and old.count() == 0
    number = store._latest()
    assert json.loads((tmp_path / "store" / "pointers" / str(number)).read_text()) == store.pointers()


def test_two_writers_lose_no_update(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", patience=0.5)
    store.ensure()
    row = lambda i: spark.createDataFrame([(i, "n", "d", "global", "", "info", None)], TABLES["rules"])
    # Another writer has claimed the next number and not yet written it.
    number = store._claim()
    with pytest.raises(TimeoutError):
        store.write(rules=row(1))
    assert store.read("rules").count() == 0
    (tmp_path / "store" / "pointers" / str(number)).write_text(json.dumps(store.pointers() | {"tasks": "elsewhere"}))
    store.write(rules=row(2))
    assert store.pointers()["tasks"] == "elsewhere" and store.read("rules").first()["id"] == 2


def test_changes_of_a_table(spark, tmp_path, monkeypatch):
    """Random changes, and what becomes of many of them: segments on top of the base, fewer segments, or a new base."""
    monkeypatch.setattr(Store, "SEGMENTS", 2)
    rnd = random.Random(1)
    for share, bases in ((1e9, 1), (0.0, 2)):
        monkeypatch.setattr(Store, "SHARE", share)
        store = Store(spark, f"file://{tmp_path}/store{bases}")
        store.ensure()
        edge = lambda src, n: (src, f"d{n}", "imports", 0.5, None)
        rows = lambda held: spark.createDataFrame(held, TABLES["edges"])
        held = {f"s{i}": [edge(f"s{i}", n) for n in range(2)] for i in range(20)}
        store.write(edges=rows([e for es in held.values() for e in es]))
        first, old = store.pointers()["edges"], store.read("edges")
        for step in range(7):
            gone = {f"s{rnd.randrange(25)}" for _ in range(3)}
            fresh = {src: [edge(src, f"{step}-{n}") for n in range(2)] for src in sorted(gone)[:2]}
            held = {k: v for k, v in held.items() if k not in gone} | fresh
            store.write(edges=(spark.createDataFrame([(g,) for g in gone], "src string"), rows([e for es in fresh.values() for e in es])), tasks=store.read("tasks"))
            assert sorted(map(tuple, store.read("edges").collect())) == sorted(e for es in held.values() for e in es)
            segments = store.pointers()["edges"]
            assert len(segments) <= 3 and all(s["gone"] for s in segments[1:])
        assert (segments[0]["rows"] == first) is (bases == 1)
        assert old.count() == 40


def test_markdown():
    pack = {"task": "t", "strategy": "s", "read_first": [{"path": "a", "summary": "b"}], "blast_radius": ["c"], "tests_to_run": [], "rules": ["r: d"], "warnings": []}
    assert markdown(pack).splitlines() == ["# t", "", "s", "", "## Read first", "- a: b", "", "## Blast radius", "- c", "", "## Rules", "- r: d"]
