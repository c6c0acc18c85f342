"""Command line: python -m millrace.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import SHOWN_AFFECTED, SHOWN_SYMBOLS
from .functions.vector import hashed_embedder
from .operators.views import match_percent, shown
from .session import Index
from .sources.store import materialized
from .sources.tree import default_excludes
from .streaming.watch import drained, poll, polled, start


def workspace_root(folder: str) -> str:
    """The nearest directory upwards that looks like a project's root."""
    here = Path(folder).resolve()
    for d in (here, *here.parents):
        if (d / "pnpm-workspace.yaml").exists() or (d / ".git").exists() or ((d / "package.json").exists() and "packages" not in d.parts):
            return str(d)
    return str(here)


def write_defaults(root: str) -> None:
    """A configuration and an ignore file, where there are none."""
    top = Path(root)
    if not (config := top / "millrace.config.json").exists():
        markers = {p.name for p in top.iterdir()}
        config.write_text(json.dumps({"indexing": {"include": ["**/*"], "exclude": default_excludes(markers)}}, indent=2))
    if not (ignore := top / ".millraceignore").exists():
        ignore.write_text("# Globs of files that are not to be indexed, one in a line.\n")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("--root", default=None)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "index", "stats", "graph", "files", "memory", "tasks", "rules"):
        sub.add_parser(name)
    for name, arg in (("context", "task"), ("search", "query"), ("blast-radius", "file"), ("dependents", "file"), ("symbols", "file")):
        sub.add_parser(name).add_argument(arg)
    sub.choices["context"].add_argument("-f", "--format", choices=["json", "markdown"], default="markdown")
    tests = sub.add_parser("tests")
    tests.add_argument("files", nargs="+")
    tests.add_argument("-r", "--run", action="store_true", help="print the tests as one line of arguments for a test runner")
    for name in ("remove-rule", "remove-task"):
        sub.add_parser(name).add_argument("id", type=int)
    watch = sub.add_parser("watch")
    watch.add_argument("--every", type=float, default=1.0, help="seconds between two looks at the tree")
    watch.add_argument("--rounds", type=int, default=None, help="looks after which to end; without it, never")
    rule = sub.add_parser("record-rule")
    rule.add_argument("name")
    rule.add_argument("description")
    rule.add_argument("-s", "--scope", default="global")
    rule.add_argument("-v", "--value", default="")
    task = sub.add_parser("record-task")
    task.add_argument("description")
    task.add_argument("outcome")
    task.add_argument("-t", "--type", default="unknown")
    task.add_argument("-n", "--notes", default="")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    root = a.root or workspace_root(os.getcwd())
    index = Index(spark, root, embedder=hashed_embedder())
    index.init()
    match a.command:
        case "init":
            write_defaults(root)
        case "index":
            print(json.dumps(index.index(lambda percent, what: print(f"{percent:3d}% {what}", file=sys.stderr))))
        case "stats" | "files" | "memory" | "tasks" | "rules":
            show(getattr(index, a.command)())
        case "graph":
            for df in index.graph():
                show(df)
        case "context":
            pack = index.context_pack(a.task)
            print(json.dumps(pack, indent=2) if a.format == "json" else markdown(pack))
        case "search":
            for r in index.semantic_search(a.query).select(match_percent(F.col("distance")).alias("percent"), "path").collect():
                print(f"{r['percent']}% {r['path']}")
        case "blast-radius":
            print(json.dumps({"file": a.file, "blast_radius": [r["path"] for r in index.blast_radius(a.file).toLocalIterator()]}, indent=2))
        case "dependents":
            show(index.direct_dependents(a.file))
        case "symbols":
            show(index.symbols_of(a.file))
        case "tests":
            found = index.related_tests(*a.files)
            print(" ".join(sorted(r["path"] for r in found.toLocalIterator()))) if a.run else show(found)
        case "record-rule":
            index.add_rule(a.name, a.description, a.scope, a.value)
        case "record-task":
            index.record_task(a.description, a.type, a.outcome, a.notes)
        case "remove-rule":
            index.remove_rule(a.id)
        case "remove-task":
            index.remove_task(a.id)
        case "watch":
            follow(index, a.every, a.rounds)


def show(df: DataFrame) -> None:
    """All rows as a list of JSON, one partition at a time."""
    print("[" + ",".join("\n  " + x for x in df.toJSON().toLocalIterator()) + "\n]")


def told(diff: DataFrame, dependents: DataFrame) -> None:
    """What a batch of changes means, as people read it; long lists end with how many more there are."""
    for change, mark in (("added", "+"), ("removed", "-")):
        rows, more = shown(diff.where(F.col("change") == change), SHOWN_SYMBOLS, ["path", "name"])
        for r in rows:
            print(f"{mark} {r['path']}: {r['name']}")
        if more:
            print(f"{mark} and {more} more")
    rows, more = shown(dependents.select("src").distinct(), SHOWN_AFFECTED, ["src"])
    for r in rows:
        print(f"! {r['src']}")
    if more:
        print(f"! and {more} more")


def follow(index: Index, every: float, rounds: int | None) -> None:
    """Looks at the tree again and again, and keeps the tables fresh by the stream of what changed, once a file has come to rest."""
    folder = f"{index.root}/.millrace/events-{uuid.uuid4().hex}"
    seen = materialized(polled(index), "polled")
    Path(folder).mkdir(parents=True)
    query = start(index, folder, f"{folder}-checkpoint", told)
    try:
        while (rounds is None or rounds > 0) and query.isActive:
            time.sleep(every)
            seen = poll(index, folder, seen)
            rounds = None if rounds is None else rounds - 1
        drained(query)
    finally:
        query.stop()


def markdown(pack: dict) -> str:
    """A context pack as text."""
    lines = [f"# {pack['task']}", "", pack["strategy"]]
    for title, items in (("Read first", [f"{r['path']}: {r['summary']}" for r in pack["read_first"]]), ("Blast radius", pack["blast_radius"]), ("Tests to run", pack["tests_to_run"]), ("Rules", pack["rules"]), ("Warnings", pack["warnings"])):
        if items:
            lines += ["", f"## {title}", *(f"- {x}" for x in items)]
    return "\n".join(lines)


if __name__ == "__main__":
    main()
