"""The engine over a tree on disk, its incremental refresh and its stream."""

import json
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from millrace.functions.vector import hashed_embedder
from millrace.session import Index
from millrace.streaming import watch


def tree(folder, **files):
    for name, text in files.items():
        p = folder / name.replace("__", "/").replace("_ts", ".ts")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_index_and_refresh(spark, tmp_path):
    root = tmp_path / "tree"
    tree(root, a_ts="export function alpha() {}", b_ts="import './a'\nexport class Beta {}", node_modules__x_ts="import '../a'")
    (root / "b.test.ts").write_text("import './b'")
    (root / "big.png").write_bytes(b"\x89")
    index = Index(spark, str(root), str(tmp_path / "store"), hashed_embedder())
    assert index.index()["files"] == 3
    assert [r["path"] for r in index.blast_radius("A.ts").collect()] == ["b.ts", "b.test.ts"]
    assert rows(index.related_tests("a.ts")) == [("b.test.ts",)]
    assert rows(index.direct_dependents("a.ts")) == [("b.ts",)]
    # A new file answers an import that was there before; a changed one is parsed again; a file that went is gone.
    (root / "b.ts").write_text("import './c'\nexport class Gamma {}")
    index.index()
    assert rows(index.blast_radius("a.ts")) == []
    (root / "c.ts").write_text("export const c = () => 1")
    (root / "a.ts").unlink()
    index.index()
    assert rows(index.table("edges").select("src", "dst")) == [("b.test.ts", "b.ts"), ("b.ts", "c.ts")]
    fresh = Index(spark, str(root), str(tmp_path / "again"), hashed_embedder())
    fresh.index()
    for t in ("symbols", "edges", "imports"):
        assert rows(index.table(t)) == rows(fresh.table(t))
    index.add_rule("style", "gamma must stay")
    index.record_task("did it")
    assert index.stats().first().asDict() == {"files": 3, "stale": 0, "symbols": 2, "edges": 2, "tasks": 1, "rules": 1}
    pack = index.context_pack("where is gamma")
    assert pack["read_first"][0]["path"] == "b.ts" and pack["rules"] == ["style: gamma must stay"] and pack["tests_to_run"] == ["b.test.ts"]
    nodes, links = index.graph()
    assert links.count() == 2 and nodes.count() == 3
    index.remove_rule(1)
    assert index.rules().count() == 0


def same_as_fresh(spark, index, folder):
    """Whether the tables are what an index of the whole tree makes."""
    fresh = Index(spark, index.root, str(folder), index.embedder)
    fresh.index()
    for t in ("symbols", "edges", "imports", "candidates", "workspace"):
        assert sorted(map(repr, index.table(t).collect())) == sorted(map(repr, fresh.table(t).collect())), t
    assert rows(index.table("files").select("path", "content_hash", "summary", "stale")) == rows(fresh.table("files").select("path", "content_hash", "summary", "stale"))


def test_partial_refreshes_equal_a_full_index(spark, tmp_path):
    """Modules, packages and crates that did not change still count; files that come or go are found or missed by old imports."""
    root = tmp_path / "tree"
    files = {
        "go.mod": "module ex.org/m\n", "main.go": 'import "ex.org/m/pkg"', "pkg/a.go": "package pkg", "other.ts": "import './later'\nimport {x} from '@x/core'", "packages/core/package.json": '{"name": "@x/core"}', "packages/core/src/index.ts": "export const x = () => 1",
        "k/Cargo.toml": '[package]\nname = "k"', "k/src/main.rs": "use crate::util;", "k/src/util.rs": "", "py/__init__.py": "", "py/m.py": "from .n import q", "use.py": "import py",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    index = Index(spark, str(root), str(tmp_path / "store"))
    told = []
    index.index(lambda percent, what: told.append(percent))
    assert told[0] == 0 and told[-1] == 100 and told == sorted(told)
    pairs = {(r["src"], r["dst"]) for r in index.table("edges").collect()}
    assert {("main.go", "pkg/a.go"), ("other.ts", "packages/core/src/index.ts"), ("k/src/main.rs", "k/src/util.rs"), ("use.py", "py/__init__.py")} <= pairs

    def refreshed(n, **changes):
        for name, text in changes.items():
            name = name.replace("__", "/").replace("_DOT_", ".")
            (root / name).unlink() if text is None else (root / name).write_text(text)
        events = spark.createDataFrame([(k.replace("__", "/").replace("_DOT_", "."), "unlink" if v is None else "change", i) for i, (k, v) in enumerate(changes.items())], "path string, event string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
        watch.applied(index, events)
        same_as_fresh(spark, index, tmp_path / f"fresh{n}")

    refreshed(1, use_DOT_py="import py\nimport other")
    assert ("main.go", "pkg/a.go") in {(r["src"], r["dst"]) for r in index.table("edges").collect()}
    refreshed(2, later_DOT_ts="export class L {}", pkg__b_DOT_go="package pkg")
    refreshed(3, pkg__a_DOT_go=None, k__src__util_DOT_rs=None)
    (root / "go.mod").write_text("module ex.org/other\n")
    index.refresh(index.scan(spark.createDataFrame([("go.mod",)], "path string")), partial=True)
    same_as_fresh(spark, index, tmp_path / "fresh4")


def test_a_refresh_writes_what_changed(spark, tmp_path):
    """Of a tree of many files a change of one is written as a few rows, and the tables are those of a full index."""
    root = tmp_path / "tree"
    root.mkdir()
    for i in range(300):
        (root / f"f{i}.ts").write_text(f"import './f{i // 2}'\n" + "\n".join(f"export function name{i}x{j}() {{}}" for j in range(40)))
    index = Index(spark, str(root), str(tmp_path / "store"), hashed_embedder())
    index.index()
    rows_in = lambda: sum(pq.read_metadata(p).num_rows for p in (tmp_path / "store").rglob("*.parquet"))
    before = rows_in()
    assert before > 300 * 43
    (root / "f7.ts").write_text("import './f9'\nexport class Other {}")
    watch.applied(index, spark.createDataFrame([("f7.ts", "change", 1)], "path string, event string, ts long").withColumn("ts", F.timestamp_seconds("ts")))
    assert rows_in() - before < 60
    assert {r["dst"] for r in index.table("edges").where("src = 'f7.ts'").collect()} == {"f9.ts"}
    assert [r["name"] for r in index.symbols_of("F7.ts").collect()] == ["Other"] and index.table("files").count() == 300
    before = rows_in()
    index.index()
    assert rows_in() == before
    same_as_fresh(spark, index, tmp_path / "fresh")


def test_retry_without_an_embedding(spark, tmp_path):
    root = tmp_path / "tree"
    tree(root, a_ts="export function alpha() {}")
    Index(spark, str(root), str(tmp_path / "store")).index()
    again = Index(spark, str(root), str(tmp_path / "store"), hashed_embedder())
    again.index()
    assert again.semantic_search("alpha").count() == 1


def test_polled_events_are_followed(spark, tmp_path, capsys):
    """The command that watches: a poll writes events, the stream reads them, people are told."""
    from millrace import cli

    root = tmp_path / "tree"
    tree(root, a_ts="export function one() {}", b_ts="import './a'")
    index = Index(spark, str(root), str(tmp_path / "store"))
    index.index()
    seen = watch.materialized(watch.polled(index), "polled")
    events = tmp_path / "events"
    events.mkdir()
    assert watch.poll(index, str(events), seen).count() == 2 and not list(events.glob("*.json"))
    (root / "a.ts").write_text("export function three() {}")
    (root / "c.ts").write_text("export class C {}")
    watch.poll(index, str(events), seen)
    watch.start(index, str(events), str(tmp_path / "cp"), cli.told, once=True).awaitTermination()
    out = capsys.readouterr().out
    assert "+ a.ts: three" in out and "- a.ts: one" in out and "+ c.ts: C" in out and "! b.ts" in out
    assert index.radius_size("a.ts") == 1


def test_command_line(spark, tmp_path, capsys):
    from millrace import cli

    root = tmp_path / "tree"
    tree(root, a_ts="export function alpha() {}", b_ts="import './a'")
    (root / "b.test.ts").write_text("import './b'")

    def run(*args):
        cli.main(["--root", str(root), *args])
        return capsys.readouterr().out

    assert json.loads(run("index")) == {"files": 3, "symbols": 1, "edges": 2, "errors": 0}
    assert json.loads(run("blast-radius", "A.ts"))["blast_radius"] == ["b.ts", "b.test.ts"]
    assert json.loads(run("dependents", "A.TS")) == [{"path": "b.ts"}]
    assert [s["name"] for s in json.loads(run("symbols", "a.ts"))] == ["alpha"]
    assert run("tests", "a.ts", "-r").strip() == "b.test.ts"
    run("record-rule", "style", "alpha stays")
    run("record-task", "did it", "success")
    assert "style: alpha stays" in run("context", "where is alpha")
    assert json.loads(run("rules"))[0]["name"] == "style" and json.loads(run("tasks"))[0]["outcome"] == "success"
    run("remove-rule", "1")
    run("remove-task", "1")
    assert json.loads(run("rules")) == json.loads(run("tasks")) == []
    assert run("search", "alpha").splitlines()[0].endswith("% a.ts")
    assert json.loads(run("stats"))[0]["files"] == 3


def test_shown_lists_say_what_is_left_out(spark, capsys):
    from millrace import cli

    cli.told(spark.createDataFrame([("a.ts", "added", f"n{i:02d}") for i in range(25)], "path string, change string, name string"), spark.createDataFrame([("a.ts", f"d{i}.ts") for i in range(8)], "dst string, src string"))
    out = capsys.readouterr().out.splitlines()
    assert out[20] == "+ and 5 more" and out[-1] == "! and 3 more" and len(out) == 27


def test_debounced_stream(spark, tmp_path):
    """With a gap, a file's events come as one once it is at rest, whether or not others follow."""
    root, events = tmp_path / "tree", tmp_path / "events"
    tree(root, a_ts="export function one() {}")
    events.mkdir()
    index = Index(spark, str(root), str(tmp_path / "store"))
    index.index()
    (root / "a.ts").write_text("export function two() {}")
    stamp = lambda s: f"2024-01-01T00:00:{s}Z"
    write = lambda n, rows: (events / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("path", "event", "ts"), r))) for r in rows))
    batches = []
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    query = watch.start(index, str(events), str(tmp_path / "cp"), lambda diff, dependents: batches.append(rows(diff)))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == store
    write(1, [("a.ts", "change", stamp("01.100")), ("a.ts", "add", stamp("01.000")), ("a.md", "change", stamp("01.100"))])
    watch.drained(query)
    assert batches == [[("a.ts", "added", "two"), ("a.ts", "removed", "one")]]
    (root / "a.ts").unlink()
    write(2, [("a.ts", "unlink", stamp("05.000"))])
    until = time.monotonic() + 60
    while index.table("files").count() and time.monotonic() < until:
        time.sleep(0.2)
    query.stop()
    assert index.table("files").count() == 0 and len(batches) == 1


def test_a_run_of_events_is_one(spark, tmp_path):
    """Events put off their file's timer; the last by time and then by name counts, and how many there were."""
    events = tmp_path / "events"
    events.mkdir()
    (events / "1.json").write_text("\n".join(json.dumps({"path": p, "event": e, "ts": f"2024-01-01T00:00:0{t}Z"}) for p, e, t in [("a", "change", 3), ("a", "add", 1), ("b", "add", 2), ("b", "change", 2), (None, "add", 1)]))
    got = []
    stream = spark.readStream.schema("path string, event string, ts timestamp").json(str(events))
    with watch._state_store(spark, watch.TIMER_STORE):
        query = watch.settled(stream).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.extend((r["path"], r["event"], r["n"]) for r in df.collect())).start()
    watch.drained(query)
    query.stop()
    assert sorted(got) == [("a", "change", 2), ("b", "change", 2)]


def test_watch(spark, tmp_path):
    root, events = tmp_path / "tree", tmp_path / "events"
    tree(root, a_ts="export function one() {}", b_ts="import './a'")
    events.mkdir()
    index = Index(spark, str(root), str(tmp_path / "store"))
    index.index()
    (root / "a.ts").write_text("export function two() {}")
    (root / "b.ts").unlink()
    (events / "1.json").write_text("\n".join(json.dumps({"path": p, "event": e, "ts": "2024-01-01T00:00:00Z"}) for p, e in (("a.ts", "change"), ("b.ts", "unlink"), ("x.md", "change"))))
    seen = []
    watch.start(index, str(events), str(tmp_path / "cp"), lambda diff, dependents: seen.extend(rows(diff)), once=True).awaitTermination()
    assert seen == [("a.ts", "added", "two"), ("a.ts", "removed", "one")]
    assert rows(index.table("files").select("path")) == [("a.ts",)]


def test_debounce(spark):
    t = F.timestamp_millis
    df = spark.createDataFrame([("a", "add", 0), ("a", "change", 250), ("a", "unlink", 501), ("b", "add", 0)], "path string, event string, ms long").withColumn("ts", t("ms"))
    got = sorted((r["path"], r["event"], r["n"]) for r in watch.debounced(df).collect())
    assert got == [("a", "change", 2), ("a", "unlink", 1), ("b", "add", 1)]
