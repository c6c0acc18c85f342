"""Ignore rules of the directories of a tree: which paths they leave out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded, hadoop, materialized, read_bytes

NAME = ".gitignore"
RULES = "dir string, line int, negated boolean, folders boolean, key string, pattern string"


def glob_pattern(glob: str) -> str:
    """A regular expression, for Java and for Python, of what a rule's glob matches below its directory.

    ``*`` and ``?`` stop at slashes, ``**`` between slashes stands for any
    number of directories, and at the end for all that is inside.
    """
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif glob[i] == "*":
            out += "[^/]*"
            while i < len(glob) and glob[i] == "*":
                i += 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2 + glob.startswith(("[!", "[^"), i))) > 0:
            inner = glob[i + 1 : end]
            inverse = inner[0] in "!^"
            inner = re.sub(r"([\[\]&~|^])", r"\\\1", inner[inverse:].replace("\\", r"\\"))
            out, i = f"{out}(?!/)[{'^' * inverse}{inner}]", end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def parsed(line: str) -> tuple[bool, bool, str, str] | None:
    """(negated, folders, key, pattern) of a line; None of blank lines and comments.

    A slash at the end means directories only; one at the beginning or inside
    ties the rule to its directory, others hold at any depth below it.  ``key`` is
    what a name must have for the rule to match: ``=name``, ``.ending`` or ``*`` for anything.
    """
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    glob = line[negated:]
    folders = glob.endswith("/") and not glob.endswith("\\/")
    glob = glob.rstrip("/") if folders else glob
    anchored = "/" in glob
    glob = glob.removeprefix("/")
    if not glob:
        return None
    last = glob.rsplit("/", 1)[-1]
    key = "*"
    if not re.search(r"[*?\[\\]", last):
        key = "=" + last
    elif m := re.search(r"\.([^.*?\[\]\\]+)$", last):
        key = "." + m[1]
    return negated, folders, key, glob_pattern(glob if anchored else "**/" + glob)


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
    for batch in batches:
        rows = [(d, i, *got) for d, i, line in zip(*(c.to_pylist() for c in batch.columns)) if line is not None and (got := parsed(line))]
        cols = list(zip(*rows)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in RULES.split(", ")])


def rules(lines: DataFrame) -> DataFrame:
    """RULES of ``lines`` (dir, line, text): the directory, '' for the root, the number and the text of each line of an ignore file."""
    return lines.select("dir", F.col("line").cast("int"), "text").mapInArrow(_rules, RULES)


def _above(path: str):
    """The directories above a path, from '' on, each with what is left of the path below it."""
    parts = F.split(path, "/")
    at = lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("below"))
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), at)


def _prefixes(path: str):
    """A path and all directories above it but the root: (node, folder)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("node"), (i < F.size(parts)).alias("folder")))


def ignored(paths: DataFrame, held: DataFrame) -> DataFrame:
    """The distinct ``paths`` (path, of files below the root) that the rules ``held`` (RULES) leave out.

    Of the rules that match a path the one in the deepest directory counts, and
    there the last.  What lies in a directory that is left out is so whatever
    other rules say.  Rules meet names by key, so that a path is tried with the
    few rules that may match it.  Null paths are in no result.
    """
    nodes = materialized(paths.where("path is not null").select("path").distinct(), "paths")
    held = bounded(materialized(held, "rules"))
    each = nodes.select(F.explode(_prefixes("path")).alias("n")).select("n.node", "n.folder").distinct()
    name = F.element_at(F.split("node", "/"), -1)
    keys = F.array_distinct(F.array(F.concat(F.lit("="), name), F.concat(F.lit("."), F.regexp_extract(name, r"\.([^.]+)$", 1)), F.lit("*")))
    asked = each.select("node", "folder", F.explode(_above("node")).alias("a"), keys.alias("keys")).select("node", "folder", "a.dir", "a.below", F.explode("keys").alias("key"))
    met = asked.join(held, ["dir", "key"]).where((F.col("folder") | ~F.col("folders")) & F.expr("rlike(below, pattern)"))
    # Directories above a path lie within each other, so the longer is the deeper.
    last = met.groupBy("node", "folder").agg(F.max_by("negated", F.struct(F.length("dir"), "line")).alias("negated"))
    out = bounded(materialized(last.where("not negated").select("node", "folder"), "ignored"))
    return nodes.select("path", F.explode(_prefixes("path")).alias("n")).select("path", "n.*").join(out, ["node", "folder"], "left_semi").select("path").distinct()


def without_ignored(files: DataFrame, held: DataFrame) -> DataFrame:
    """``files`` (path, ...) that the rules do not leave out."""
    return files.join(ignored(files.select("path"), held), "path", "left_anti")


def _lines(spark: SparkSession, fs, path, where: str) -> list[tuple[str, int, str]]:
    return [(where, i, line) for i, line in enumerate(read_bytes(fs, path).decode("utf-8", "replace").split("\n"))]


def tree_rules(spark: SparkSession, root: str) -> DataFrame:
    """RULES of all ignore files of the tree under ``root``; those in directories that are left out change nothing."""
    found, depth = [], 0
    while True:
        fs, below = hadoop(spark, re.sub(r"([\[\]{}*?\\])", r"\\\1", root) + "/*" * depth)
        for status in fs.globStatus(hadoop(spark, f"{below.toString()}/{NAME}")[1]) or ():
            path = status.getPath()
            folder = fs.makeQualified(hadoop(spark, root)[1]).toUri().getPath()
            found += _lines(spark, fs, path, path.getParent().toUri().getPath().removeprefix(folder).strip("/"))
        depth += 1
        if not fs.globStatus(hadoop(spark, f"{below.toString()}/*")[1]):
            break
    return rules(spark.createDataFrame(found, "dir string, line int, text string"))


def rules_above(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """RULES of the ignore files in the directories above a few ``paths``; no other directory is looked at."""
    found = []
    for where in sorted({"/".join(p.split("/")[:n]) for p in paths for n in range(p.count("/") + 1)}):
        fs, path = hadoop(spark, f"{root}/{where}/{NAME}" if where else f"{root}/{NAME}")
        if fs.exists(path):
            found += _lines(spark, fs, path, where)
    return rules(spark.createDataFrame(found, "dir string, line int, text string"))
