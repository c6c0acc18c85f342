"""Source trees as tables."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BINARY, EXCLUDED, GENERATED, MARKED_EXCLUDED, MAX_BYTES, PROJECT_EXCLUDED
from .ignore import rules_above, tree_rules, without_ignored
from .store import hadoop, materialized, read_bytes


def glob_regex(glob: str) -> str:
    """A regular expression that matches the relative paths a glob matches."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def any_glob(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def extension(path: Column) -> Column:
    """The last extension of a path; names that begin with their only dot have none."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def relative(path: Column, root: str) -> Column:
    bare = re.sub(r"^file:/*", "/", root).rstrip("/")
    return F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), "^" + re.escape(bare) + "/", "")


def excluded_globs(user: list[str] = (), ignore_lines: list[str] = ()) -> list[str]:
    """The union of the built-in lists, the user's, and an ignore file's lines, in that order."""
    lines = [x.strip() for x in ignore_lines]
    return list(dict.fromkeys([*EXCLUDED, *GENERATED, *user, *(x for x in lines if x and not x.startswith("#"))]))


def default_excludes(markers: set[str]) -> list[str]:
    """What a new project excludes, given the marker files at its root."""
    return list(dict.fromkeys([*PROJECT_EXCLUDED, *(g for m, more in MARKED_EXCLUDED.items() if m in markers for g in more)]))


def guarded(files: DataFrame, include: list[str] | None = None, excludes: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``files`` (path, length, ...) that are to be indexed."""
    hidden = F.col("path").rlike(r"(^|/)\.")
    keep = (F.col("length") <= max_bytes) & ~F.lower(extension(F.col("path"))).isin(BINARY) & ~hidden
    if include:
        keep &= any_glob(F.col("path"), include)
    return files.where(keep & ~any_glob(F.col("path"), excludes if excludes is not None else excluded_globs()))


def content_hash(content: Column, length: Column | None = None, modified: Column | None = None, max_bytes: int = MAX_BYTES) -> Column:
    """A hash to tell changed contents; very large files by their time instead."""
    h = F.lower(F.hex(F.xxhash64(content)))
    return h if length is None else F.when(length > max_bytes, F.concat(F.lit("large-file-"), modified.cast("string"))).otherwise(h)


_STATUS = re.compile(r"path=([^{}]*?); isDirectory=(true|false);(?: length=(\d+);)?[^{}]*?modification_time=(\d+)")
#: Bytes of files that are read one by one before they are written.
TOGETHER = 1 << 25


def underscored(spark: SparkSession, root: str) -> tuple[list[tuple[str, int, float]], list[str]]:
    """Files (path, length, seconds) and folders whose names begin with an underscore, by patterns of every depth.

    Spark takes such names for its own and leaves them out of every read.
    """
    fs, _ = hadoop(spark, root)
    java, gateway = spark.sparkContext._jvm.java, spark.sparkContext._gateway

    def text(found) -> str:
        """All of an array as one string, as every look at an entry is a call of its own."""
        copy = gateway.new_array(java.lang.Object, len(found))
        java.lang.System.arraycopy(found, 0, copy, 0, len(found))
        return java.util.Arrays.toString(copy)

    path = lambda pattern: hadoop(spark, re.sub(r"([\[\]{}*?\\])", r"\\\1", root) + pattern)[1]
    files, folders, depth = [], [], 0
    while True:
        for name, folder, length, modified in _STATUS.findall(text(fs.globStatus(path("/*" * depth + "/_*")))):
            if folder == "true":
                folders.append(name)
            else:
                files.append((name, int(length or 0), int(modified) / 1000))
        depth += 1
        if not fs.globStatus(path("/*" * depth)):
            return files, folders


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of all files under ``root``, without a look at contents.

    Spark leaves files of no bytes out of every read, so these are told from
    its list of all files.
    """
    files, folders = underscored(spark, root)
    shape = "path string, length long, seconds double"
    out = spark.createDataFrame(files, shape).select(relative(F.col("path"), root).alias("path"), "length", F.timestamp_seconds("seconds").alias("modified"))
    for top in (root, *folders):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top)
        some = raw.select(relative(F.col("path"), root).alias("path"), "length", F.col("modificationTime").alias("modified"))
        names = spark.createDataFrame([(unquote(f),) for f in raw.inputFiles()], "path string")  # Spark lists files on the driver in any case
        empty = names.select(relative(F.col("path"), root).alias("path")).join(some, "path", "left_anti")
        out = out.unionByName(some).unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified")))
    return out.dropDuplicates(["path"])


#: Named files up to which each is asked for by itself; for more of them the tree is listed.
NAMED = 2000


def stated(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, length, modified) of those of a few ``paths`` that are files, without a look at any other."""
    found = []
    for p in paths:
        fs, path = hadoop(spark, f"{root}/{p}")
        if fs.exists(path) and (status := fs.getFileStatus(path)).isFile():
            found.append((p, status.getLen(), status.getModificationTime() / 1000))
    return spark.createDataFrame(found, "path string, length long, seconds double").select("path", "length", F.timestamp_seconds("seconds").alias("modified"))


def _read_one_by_one(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, content, length, modified) of ``files`` that Spark does not read itself, a few at a time."""
    shape = "path string, content binary, length long, modified timestamp"
    out, held, size = spark.createDataFrame([], shape), [], 0

    def written() -> DataFrame:
        return out.unionByName(materialized(spark.createDataFrame(held, shape), "read"))

    for r in files.toLocalIterator():
        fs, path = hadoop(spark, f"{root}/{r['path']}")
        content = read_bytes(fs, path)
        held.append((r["path"], bytearray(content), r["length"], r["modified"]))
        size += len(content)
        if size > TOGETHER:
            out, held, size = written(), [], 0
    return written() if held else out


def text_of(content: Column) -> Column:
    """Bytes as text without a mark of byte order; bytes that are no UTF-8 become marks of replacement."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\\uFEFF", "")


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] = (), max_bytes: int = MAX_BYTES, paths: DataFrame | None = None) -> DataFrame:
    """(path, content, length, modified, content_hash, error) of the files under ``root`` that are to be indexed, or of those among ``paths`` (path).

    Of a few ``paths`` nothing else of the tree is looked at but the ignore
    files above them.  Paths and sizes are filtered before any content is read, those that a
    directory's ignore rules leave out are, too, and only
    directories that hold a file to be indexed are read.  ``error`` says
    whether a file isn't plain UTF-8.
    """
    named = None if paths is None else [r[0] for r in paths.select("path").distinct().limit(NAMED + 1).collect()]
    few = named is not None and len(named) <= NAMED
    files = guarded(stated(spark, root, named) if few else listed(spark, root), include, excluded_globs(list(exclude), ignore_lines(spark, root)), max_bytes)
    if paths is not None and not few:
        files = files.join(paths, "path", "left_semi")
    files = materialized(without_ignored(files, rules_above(spark, root, named) if few else tree_rules(spark, root)), "listed")
    some = files.where("length > 0")
    hidden = F.col("path").rlike("(^|/)_[^/]*$")
    folders = [r[0] for r in some.where(~hidden).select(F.regexp_replace("path", "/?[^/]*$", "").alias("d")).distinct().collect()]  # of one tree
    raw = _read_one_by_one(spark, root, some.where(hidden))
    if folders:
        where = [f"{root}/{d}" if d else root for d in folders]
        if few:  # only the files that are named
            where = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f"{root}/{r[0]}") for r in some.where(~hidden).select("path").collect()]
        read = spark.read.format("binaryFile").load(where).where(F.col("length") <= max_bytes)
        read = read.select(relative(F.col("path"), root).alias("path"), "content", "length", F.col("modificationTime").alias("modified"))
        raw = raw.unionByName(read.join(files.select("path"), "path", "left_semi"))
    raw = raw.unionByName(files.where("length = 0").select("path", F.lit("").cast("binary").alias("content"), "length", "modified"))
    error = F.when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    return raw.select("path", text_of(F.col("content")).alias("content"), "length", "modified", content_hash(F.col("content")).alias("content_hash"), error.alias("error"))


def _lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a configuration file, whatever its name begins with; none if it isn't there."""
    fs, path = hadoop(spark, path)
    return read_bytes(fs, path).decode("utf-8", "replace").splitlines() if fs.exists(path) else []


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    return _lines(spark, f"{root}/.millraceignore")


def config(spark: SparkSession, root: str) -> dict:
    """The project's configuration: at its root, or else in the engine's folder; a broken one counts as none."""
    for path in (f"{root}/millrace.config.json", f"{root}/.millrace/config.json"):
        if lines := _lines(spark, path):
            try:
                return json.loads("\n".join(lines))
            except ValueError:
                return {}
    return {}


def workspace(files: DataFrame) -> DataFrame:
    """(path, kind, name, dir) of what ``files`` (path, content) say of modules, packages and crates.

    The root's go.mod names the module, packages/*/package.json and the root's
    the packages, and every Cargo.toml a crate by its name and with underscores
    for hyphens.  A Cargo.toml without a name marks a crate's root all the same.
    """
    path, content = F.col("path"), F.col("content")
    module = F.struct(F.lit("module").alias("kind"), F.trim(F.regexp_extract(content, r"(?m)^module\s+(.+)$", 1)).alias("name"))
    package = F.struct(F.lit("package").alias("kind"), F.get_json_object(content, "$.name").alias("name"))
    crate = F.regexp_extract(content, r"""(?m)^name\s*=\s*["'](.+?)["']""", 1)
    crates = F.array_distinct(F.array(*[F.struct(F.lit("crate").alias("kind"), c.alias("name")) for c in (crate, F.translate(crate, "-", "_"))]))
    found = F.when(path == "go.mod", F.array(module)).when(path.rlike(r"^(packages/[^/]+/)?package\.json$"), F.array(package)).when(path.rlike(r"(^|/)Cargo\.toml$"), crates)
    rows = files.select("path", F.explode(found).alias("f"), F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"))
    return rows.select("path", "f.kind", "f.name", "dir").where("name is not null and (kind = 'crate' or name <> '')")


def go_module(workspace: DataFrame) -> str | None:
    return (workspace.where("kind = 'module'").select("name").first() or [None])[0]


def packages(workspace: DataFrame) -> DataFrame:
    """(name, dir) of the packages; of two of one name the root's counts."""
    return workspace.where("kind = 'package'").groupBy("name").agg(F.min("dir").alias("dir"))


def crates(workspace: DataFrame) -> DataFrame:
    """(name, dir) of the crates."""
    return workspace.where("kind = 'crate'").select("name", "dir").distinct()
