"""Extraction, resolution, graph and ranking over small trees of source files."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.extract import extracted, imports_of, symbols_of
from millrace.operators import graph, rank
from millrace.operators.resolve import resolved
from millrace.sources import tree


def edges(spark, files, module=None, parity=False):
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    parsed = extracted(df, parity)
    imports = parsed.select("path", "ext", F.explode("imports").alias("i")).select("path", "ext", "i.source", "i.type", "i.dynamic")
    held = tree.workspace(df)
    return resolved(imports, df.select("path"), tree.packages(held), module or tree.go_module(held), tree.crates(held), parity)


def radius(spark, e, *starts):
    found = graph.blast_radius(e, spark.createDataFrame([(0, s) for s in starts], "origin int, node string"))
    return {r[0] for r in found.select(graph.shown()).collect()}


#: For each language: the file that imports, how it does, and what it means.
CANARIES = [
    ("d1.c", '#include "core/utils.h"', "core/utils.h"),
    ("d1.cpp", '#include "core/utils.h"', "core/utils.h"),
    ("d1.cs", "using core.utils;", "core/utils.cs"),
    ("d1.dart", "import 'core/utils.dart';", "core/utils.dart"),
    ("d1.ex", "alias Core.Utils", "core/utils.ex"),
    ("d1.java", "import core.utils;", "core/utils.java"),
    ("d1.js", "import u from './core/utils.js'", "core/utils.js"),
    ("d1.jl", 'include("core/utils.jl")', "core/utils.jl"),
    ("d1.kt", "import core.utils", "core/utils.kt"),
    ("d1.lua", 'local u = require "core.utils"', "core/utils.lua"),
    ("d1.m", '#import "core/utils.h"', "core/utils.h"),
    ("d1.php", "<?php\nuse core\\utils;", "core/utils.php"),
    ("d1.ps1", ". ./core/utils.ps1", "core/utils.ps1"),
    ("d1.py", "\ufefffrom .core.utils import f", "core/utils.py"),
    ("d1.rb", "require_relative 'core/utils'", "core/utils.rb"),
    ("d1.rs", "\ufeffuse crate::core::utils;", "core/utils.rs"),
    ("d1.scala", "import core.utils", "core/utils.scala"),
    ("d1.svelte", "<script>import u from './core/utils.js'</script>", "core/utils.svelte"),
    ("d1.swift", "import core_utils", "core/utils.swift"),
    ("d1.sv", '`include "core/utils.sv"', "core/utils.sv"),
    ("d1.ts", "import { u } from './core/utils'", "core/utils.ts"),
    ("d1.v", '`include "core/utils.v"', "core/utils.v"),
    ("d1.vue", "<script>import u from './core/utils.js'</script>", "core/utils.vue"),
    ("d1.zig", 'const u = @import("core/utils.zig");', "core/utils.zig"),
    ("d1.sh", "source core/utils.sh", "core/utils.sh"),
    ("d1.tsx", "export { u } from './core/utils'", "core/utils.tsx"),
    ("d1.jsx", "const u = require('./core/utils')", "core/utils.jsx"),
]


#: Trees of one language each: files, what of them is reached from core/utils, and what more without known quirks.
CLOSURES = [
    ("ts", {"b1.ts": 'import { u } from "./barrel";', "b2.ts": 'import { u } from "./barrel";', "barrel/index.ts": 'export * from "../core/utils";', "core/utils.ts": "", "d1.ts": 'import { u } from "./core/utils";', "dynamic.ts": 'const load = async () => { await import("./core/utils"); };', "t1.ts": 'import { u } from "./b1";', "t2.ts": 'import { u } from "./t1";', "typeOnly.ts": 'import type { U } from "./core/utils";'},
     {"d1", "barrel/index", "b1", "b2", "t1", "t2", "dynamic"}, set()),
    ("py", {"b1.py": "from .barrel import u", "b2.py": "from .barrel import u", "barrel/__init__.py": "from ..core.utils import *", "core/utils.py": "", "d1.py": "from .core import utils", "d2.py": "from .core.utils import u", "dynamic.py": 'import importlib\nmod = importlib.import_module(".core.utils", package=__package__)', "t1.py": "from .b1 import u", "t2.py": "from .t1 import u", "typeOnly.py": "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from .core.utils import u"},
     {"d1", "d2", "barrel/__init__", "b1", "b2", "t1", "t2", "typeOnly"}, set()),
    ("go", {"b1.go": 'import "x/go/barrel"', "b2.go": 'import "x/go/barrel"', "barrel/barrel.go": 'import "x/go/core"', "core/utils.go": "", "d1.go": 'import "./core"', "d2.go": 'package c\nimport "x/go/core"', "t1.go": "func T1() { B1() }", "t2.go": "func T2() { T1() }"},
     {"d1", "d2", "barrel/barrel", "b1", "b2"}, set()),
    ("rs", {"b1.rs": "use crate::barrel::u;", "b2.rs": "use crate::barrel::u;", "barrel/mod.rs": "pub use crate::core::utils::u;", "core/utils.rs": "", "d1.rs": "mod core {}\nuse crate::core::utils;", "d2.rs": "use crate::core::utils::u;", "t1.rs": "use crate::b1;", "t2.rs": "use crate::t1;"},
     {"d1", "d2"}, {"barrel/mod", "b1", "b2", "t1", "t2"}),
]


def test_whole_closures(spark):
    """Through directories' entry files, re-exports and chains; type imports and calls of an import function at run time are left out."""
    files = {f"x/{lang}/{name}": "\ufeff" + text for lang, tree_, _, _ in CLOSURES for name, text in tree_.items()}
    for parity in (True, False):
        e = edges(spark, files, parity=parity).cache()
        starts = spark.createDataFrame([(i, f"x/{lang}/core/utils.{lang}") for i, (lang, *_) in enumerate(CLOSURES)], "origin int, node string")
        got = {}
        for r in graph.blast_radius(e, starts).where("not unresolvable").collect():
            got.setdefault(r["origin"], set()).add(r["path"])
        for i, (lang, _, plain, more) in enumerate(CLOSURES):
            assert got[i] == {f"x/{lang}/{p}.{lang}" for p in plain | (set() if parity else more)}, (lang, parity)


def test_each_language(spark):
    files = {}
    for name, text, target in CANARIES:
        lang = name.split(".")[1]
        files[f"{lang}/{name}"] = text
        files[f"{lang}/{target}"] = "x"
    got = {(r["src"], r["dst"]) for r in edges(spark, files).collect()}
    missing = [name for name, _, target in CANARIES if (f"{name.split('.')[1]}/{name}", f"{name.split('.')[1]}/{target}") not in got]
    assert not missing


def test_go_module_fans_out(spark):
    e = edges(spark, {"go.mod": "module example.com/m\n", "pkg/math.go": "package pkg", "pkg/more.go": "package pkg", "main.go": 'import (\n"example.com/m/pkg"\n)'}, "example.com/m")
    assert {(r["src"], r["dst"]) for r in e.collect()} == {("main.go", "pkg/math.go"), ("main.go", "pkg/more.go")}


def test_script_graph(spark):
    e = edges(
        spark,
        {
            "A.ts": "import './C'", "B.ts": "import {a} from './A'", "C.ts": "import {b} from './B'",  # a cycle
            "types.ts": "export type T = 1", "consumer.ts": "import type {T} from './types'",
            "plugin.ts": "", "loader.ts": "const p = 'plugin';\nimport(`./${p}`)", "late.ts": "import './loader'",
            "auth/login.ts": "", "auth/index.ts": "export * from './login'", "app.ts": "import {l} from './auth'",
            "packages/core/package.json": '{"name": "@x/core"}', "packages/core/src/index.ts": "", "use.ts": "import c from '@x/core'", "missing.ts": "import './nothing'", "index.ts": "",
        },
    ).cache()
    assert radius(spark, e, "A.ts") == {"B.ts", "C.ts"}
    assert radius(spark, e, "types.ts") == set()
    assert radius(spark, e, "plugin.ts") == {"UNRESOLVABLE: loader.ts"}
    assert radius(spark, e, "auth/login.ts") == {"auth/index.ts", "app.ts"}
    assert radius(spark, e, "packages/core/src/index.ts") == {"use.ts"}
    assert radius(spark, e, "index.ts") == set()
    rel = {r["src"]: (r["relation"], r["confidence"], r["provenance"]) for r in e.collect()}
    assert rel["consumer.ts"] == ("imports:type", 0.5, "static_analysis")
    assert rel["loader.ts"] == ("imports:dynamic", 0.3, "dynamic_analysis")


def test_crates_begin_at_the_nearest_manifest_or_source_folder(spark):
    files = {"c/Cargo.toml": '[package]\nname = "my-crate"', "c/src/main.rs": "use crate::util::x;", "c/src/util.rs": "", "src/util.rs": "", "d/src/deep/a.rs": "use crate::deep::b::T;\nuse super::deep::b;", "d/src/deep/b.rs": ""}
    assert {(r["src"], r["dst"]) for r in edges(spark, files).collect()} == {("c/src/main.rs", "c/src/util.rs"), ("d/src/deep/a.rs", "d/src/deep/b.rs")}


def test_case_counts_only_where_there_is_a_choice(spark):
    e = edges(spark, {"a.ts": "import './Util'\nimport './B'", "util.ts": "", "b.ts": "", "B.ts": ""})
    assert {(r["src"], r["dst"]) for r in e.collect()} == {("a.ts", "util.ts"), ("a.ts", "B.ts")}


def test_paths_are_normalized(spark):
    from millrace.operators.resolve import normalized

    rows = [("a/b/../c", "a/c"), ("./a//b/.", "a/b"), ("../a", None), ("a/../../b", None), ("", ""), ("..", None), ("a/..", "")]
    got = spark.createDataFrame(rows, "p string, want string").select("want", normalized(F.split("p", "/")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_parity_strips_a_missing_file(spark):
    files = {"a/missing.ts": "import './nothing'", "a/index.ts": ""}
    assert edges(spark, files).count() == 0
    assert edges(spark, files, parity=True).count() == 1


def test_import_merge():
    assert imports_of(".ts", "import type {A} from './a'; import {b} from './a'") == [("./a", "value", False)]
    assert imports_of(".py", "import a.b as c, d\nfrom . import x\nfrom ..p import q as r, s") == [("a/b", "value", False), ("d", "value", False), ("./x", "value", False), ("../p/q", "value", False), ("../p/s", "value", False)]
    assert imports_of(".html", "<a>") == [] and imports_of(".xyz", "import a") == []


def test_symbols():
    got = symbols_of(".ts", "export function f() {}\nclass C {\n  m(a) {\n    if (a) {\n}}}\nconst g = async (x) => x\n")
    assert got == [("f", "function", 1), ("C", "class", 2), ("m", "method", 3), ("g", "variable", 6)]
    assert symbols_of(".py", "class A:\n  def f(self): pass\n") == [("A", "class", 1), ("f", "function", 2)]


def test_docstrings_and_a_second_extractor(spark):
    text = "# Adds two numbers, and says so at some length that is more than fifty characters\ndef add(a, b):\n    pass\n\n/** Block\n * more */\ndef sub(): pass\nx = 1\ndef bare(): pass\n"
    df = spark.createDataFrame([("a.py", text), ("b.ts", "/** doc */\nfunction f() {}"), ("c.vue", "<script>import x from './b'</script>")], "path string, content string")

    def grammar(ext, text):
        return ([("f", "function", 1, "again"), ("Comp", "class", 1, "A component")], [("./b", "value", False), ("./new", "type", False)]) if ext == ".vue" else None

    got = {r["path"]: r for r in extracted(df, extractor=grammar).collect()}
    assert [(s["name"], s["docstring"]) for s in got["a.py"]["symbols"]] == [("add", "Adds two numbers, and says so at some length that is more than fifty characters"), ("sub", None), ("bare", None)]
    assert [(s["name"], s["docstring"]) for s in got["b.ts"]["symbols"]] == [("f", None)]
    assert [s["name"] for s in got["c.vue"]["symbols"]] == ["f", "Comp"] and [i["source"] for i in got["c.vue"]["imports"]] == ["./b", "./new"]
    from millrace.functions.gist import gist

    kept = extracted(df, parity=True).where("path = 'a.py'").first()["symbols"]
    assert kept[0]["docstring"].startswith("# Adds two")
    summary = extracted(df, extractor=grammar).where("path = 'a.py'").select(gist(F.col("symbols"), F.col("imports"))).first()[0]
    assert summary == "Key logic: add (Adds two numbers, and says so at some length that ), sub, bare."


def test_fixture_sets(spark):
    from millrace.operators import views

    rows = [("one", ["A.ts", "b.ts"], [], ["c.ts"], ["a.ts", "d.ts"]), ("two", ["a.ts"], ["UNRESOLVABLE: x"], ["B.ts"], ["a.ts", "unresolvable: X", "b.ts"]), ("three", [], None, [], [])]
    df = spark.createDataFrame(rows, "fixture string, expected array<string>, unresolvable array<string>, banned array<string>, actual array<string>")
    got = {r["fixture"]: tuple(r)[1:] for r in views.fixture_sets(df).collect()}
    assert got == {"one": (["b.ts"], ["d.ts"], [], False), "two": ([], ["b.ts"], ["b.ts"], False), "three": ([], [], [], True)}
    assert views.pass_rate(views.fixture_sets(df)).first()[0] == pytest.approx(100 / 3)


def test_too_deep_a_graph_is_an_error(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "src string, dst string")
    starts = spark.createDataFrame([(0, "12")], "origin int, node string")
    assert graph.closure(chain, starts).agg(F.max("depth"), F.count("*")).first() == (12, 13)
    with pytest.raises(RuntimeError):
        graph.closure(chain, starts, max_depth=5)


def test_closure_matches_plain_search(spark):
    import random

    rnd = random.Random(5)
    pairs = {(str(rnd.randrange(25)), str(rnd.randrange(25))) for _ in range(50)}
    df = spark.createDataFrame([(a, b, "imports") for a, b in pairs], "src string, dst string, relation string")
    got = {(r["origin"], r["node"]): r["depth"] for r in graph.closure(df, spark.createDataFrame([(0, "1"), (1, "2")], "origin int, node string")).collect()}
    for origin, start in ((0, "1"), (1, "2")):
        seen, level, depth = {start: 0}, [start], 0
        while level:
            depth += 1
            level = sorted({a for a, b in pairs if b in level} - set(seen))
            seen |= dict.fromkeys(level, depth)
        assert {n: d for (o, n), d in got.items() if o == origin} == seen


def test_ranking(spark):
    files = spark.createDataFrame([("src/auth.ts", "implement things", False), ("src/database.ts", "x", False), ("src/other.ts", "the database", True)], "path string, summary string, stale boolean")
    symbols = spark.createDataFrame([], "path string, name string")
    none = spark.createDataFrame([], "src string, dst string, relation string")
    rules = spark.createDataFrame([(1, "db", "about the database"), (2, "z", "y")], "id long, name string, description string")
    assert rank.context_pack(spark, "implement auth", files, symbols, none, rules)["read_first"][0]["path"] == "src/auth.ts"
    pack = rank.context_pack(spark, "database", files, symbols, none, rules)
    assert [r["path"] for r in pack["read_first"]] == ["src/database.ts"] and pack["rules"] == ["db: about the database"]
    assert rank.context_pack(spark, "the and", files, symbols, none, rules)["read_first"] == []


@pytest.mark.parametrize(("path", "ext"), [(".env", ""), ("a/b.tar.gz", ".gz"), ("x.ts", ".ts"), ("a.b/c", "")])
def test_extension(spark, path, ext):
    assert spark.createDataFrame([(path,)], "p string").select(tree.extension(F.col("p"))).first()[0] == ext
