"""Import resolution: every import to the first file its candidates name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CONFIDENCE, ENTRIES, SUFFIXES
from ..sources.store import materialized
from ..sources.tree import extension
from .pairs import pairs

_SCRIPT = [".ts", ".tsx", ".js", ".jsx"]
#: Room between two candidates for the ways to complete a path, and between two attempts for the candidates of each.
_STEP, _ATTEMPT = 1000, 1_000_000
#: What the rank of a match has on top if only letter case tells it from what was asked for.
_OTHER_CASE = 100_000_000


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def normalized(parts: Column) -> Column:
    """The path that ``parts`` name from the root on; null above the root."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    up = lambda acc: F.when((F.size(acc) == 0) | (last(acc) == ".."), F.array_append(acc, F.lit(".."))).otherwise(F.slice(acc, 1, F.size(acc) - 1))
    joined = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", up(acc)).otherwise(F.array_append(acc, x)))
    path = F.array_join(joined, "/")
    return F.when((path == "..") | path.startswith("../"), None).otherwise(path)


def bare_source(source: Column) -> Column:
    return F.regexp_replace(source, r"\.(js|jsx|ts|tsx)$", "")


def package_name(source: Column) -> Column:
    """The package that an import of a script names: its first segment, or two if it has a scope."""
    parts = F.split(bare_source(source), "/")
    return F.array_join(F.slice(parts, 1, F.when(source.startswith("@"), 2).otherwise(1)), "/")


def attempts(path: Column, ext: Column, source: Column, module: str | None, package_dir: Column, crate_dir: Column, parity: bool = False) -> Column:
    """Array of (part, base, rest): where to look for an import, best first within each part; each part gives a target of its own."""
    here, root = folder_of(path), F.lit("")

    def attempt(base: Column, rest: Column, part: int = 0) -> Column:
        return F.struct(F.lit(part).alias("part"), base.alias("base"), rest.alias("rest"))

    bare = bare_source(source)
    size = F.when(source.startswith("@"), 2).otherwise(1)
    inner = F.array_join(F.slice(F.split(bare, "/"), size + 1, F.size(F.split(bare, "/"))), "/")
    script = F.array(attempt(here, bare), attempt(here, source), attempt(package_dir, F.when(inner == "", "src").otherwise(inner)), attempt(root, bare))
    slashed = F.replace(source, F.lit("::"), F.lit("/"))
    inside = F.regexp_replace(slashed, "^crate/?", "")
    crate = F.array(attempt(crate_dir, F.regexp_replace(slashed, "^crate", "src")), attempt(here, inside, 1))
    if not parity:  # without a crate's root, any directory above may be it
        above = F.transform(F.sequence(F.size(F.split(here, "/")) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(F.split(here, "/"), F.lit(1), n), "/"))
        crate = F.concat(crate, F.when(crate_dir.isNull(), F.transform(above, lambda d: attempt(d, inside, 1))).otherwise(F.array().cast("array<struct<part:int,base:string,rest:string>>")))
    rust = (
        F.when(source.startswith("crate"), crate)
        .when(source.startswith("super"), F.array(attempt(here, F.regexp_replace(slashed, "^super", ".."))))
        .when(source.startswith("self"), F.array(attempt(here, F.regexp_replace(slashed, "^self", "."))))
        .otherwise(F.array(attempt(root, slashed)))
    )
    local = F.when(source.startswith(module), F.regexp_replace(F.substring(source, len(module) + 1, 1 << 30), "^/", "")).otherwise(source) if module else source
    go = F.array(attempt(F.when(local.startswith("."), here).otherwise(root), local))
    return F.when(ext.isin(_SCRIPT), script).when(ext == ".rs", rust).when(ext == ".go", go).otherwise(F.array(attempt(here, source), attempt(root, source)))


def crate_roots(sources: DataFrame, files: DataFrame, crates: DataFrame | None) -> DataFrame:
    """(path, crate_dir): the nearest directory above each of ``sources`` (path) with a manifest of a crate or a folder src."""
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    roots = folders(files).where(F.col("key").rlike("(^|/)src$")).select(folder_of(F.col("key")).alias("dir"))
    if crates is not None:
        roots = roots.union(crates.select("dir"))
    met = sources.select("path", F.explode(above).alias("dir")).join(roots.distinct(), "dir")
    return met.groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("crate_dir"))


def candidates(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None, module: str | None = None, crates: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """(src, ext, source, relation, part, rank, key, folder): the paths that each of ``imports`` (path, ext, source, type, dynamic) may mean, as a file or a folder, best first."""
    relation = F.when(F.col("dynamic"), "imports:dynamic").when(F.col("type") == "type", "imports:type").otherwise("imports")
    rows = imports.select("path", "ext", "source", relation.alias("relation"), package_name(F.col("source")).alias("name"))
    none = F.lit(None).cast("string")
    if packages is None:
        rows = rows.withColumn("package_dir", none)
    else:
        rows = rows.join(packages.select("name", F.col("dir").alias("package_dir")), "name", "left")
    roots = crate_roots(rows.where("ext = '.rs' and source like 'crate%'").select("path").distinct(), files, crates)
    rows = rows.join(roots, "path", "left")
    tried = attempts(F.col("path"), F.col("ext"), F.col("source"), module, F.col("package_dir"), F.col("crate_dir"), parity)
    rows = rows.select(F.col("path").alias("src"), "ext", "source", "relation", F.posexplode(tried).alias("a", "t")).where("t.base is not null and t.rest <> ''")
    base, rest = F.col("t.base"), F.col("t.rest")
    # A name without slashes has dots for them, as of Java or Python.
    plain = rest.contains("/") | rest.contains("\\") | ~rest.contains(".")
    if not parity:
        plain |= rest.rlike(r"^\.+$")
    parts = F.split(F.when(plain, rest).otherwise(F.replace(rest, F.lit("."), F.lit("/"))), "/")
    shortest = F.lit(1)
    if not parity:  # a missing ./x is missing, not what ./ holds
        shortest = F.when(F.col("ext").isin([*_SCRIPT, ".vue", ".svelte"]) & rest.startswith("."), F.size(parts)).otherwise(1)
    bases = F.filter(F.split(base, "/"), lambda x: x != "")
    found = F.transform(F.sequence(F.size(parts), shortest, F.lit(-1)), lambda n: F.struct(normalized(F.concat(bases, F.slice(parts, F.lit(1), n))).alias("path"), F.array(F.lit(False), F.lit(True)).alias("kinds")))
    anywhere = F.when(rest.startswith("."), F.array()).otherwise(F.array(F.struct(normalized(parts).alias("path"), F.array(F.lit(False)).alias("kinds"))))
    rows = rows.select("src", "ext", "source", "relation", "t.part", "a", F.posexplode(F.concat(found, anywhere)).alias("i", "c")).where("c.path is not null")
    rows = rows.select("src", "ext", "source", "relation", "part", (F.col("a") * _ATTEMPT + F.col("i") * 2 * _STEP).alias("rank"), F.col("c.path").alias("path"), F.explode("c.kinds").alias("folder"))
    # A file may also be meant without the last extension of its name.
    last = extension(F.col("path"))
    bare = F.when(~F.col("folder") & (last != ""), F.struct(F.left(F.col("path"), F.length("path") - F.length(last)).alias("key"), F.lit(6 * len(SUFFIXES)).alias("more")))
    keys = F.filter(F.array(F.struct(F.col("path").alias("key"), F.col("folder").cast("int").alias("more")), bare), lambda c: c.isNotNull())
    return rows.select("src", "ext", "source", "relation", "part", "rank", "folder", F.explode(keys).alias("k")).select("src", "ext", "source", "relation", "part", (F.col("rank") + F.when(F.col("folder"), _STEP).otherwise(F.col("k.more"))).cast("int").alias("rank"), "k.key", "folder")


def file_keys(files: DataFrame) -> DataFrame:
    """(key, way, target): by which paths each file can be meant, and how good a match each is.

    A path may leave out a known suffix, and the name of a file that stands for
    its directory.  Inverted like this an import has a few candidates to look up,
    not one for each suffix.
    """
    path = F.col("path")
    by_suffix = F.filter(
        F.array(*[F.when(path.endswith(s), F.struct(F.lit(i).alias("i"), F.expr(f"left(path, length(path) - {len(s)})").alias("stem"))) for i, s in enumerate(SUFFIXES)]), lambda c: c.isNotNull()
    )
    stems = files.select(path.alias("target"), F.explode(by_suffix).alias("c")).select("target", "c.i", "c.stem")
    name, folder = F.regexp_extract("stem", r"([^/]*)$", 1), F.regexp_replace("stem", r"/?[^/]*$", "")
    entry = F.array_position(F.array(*map(F.lit, ENTRIES)), name).cast("int")
    plain = F.struct(F.col("stem").alias("key"), (F.col("i") * 6).alias("way"))
    through = F.when(entry > 0, F.struct(folder.alias("key"), (F.col("i") * 6 + entry).alias("way")))
    ways = F.filter(F.array(plain, through), lambda c: c.isNotNull())
    return stems.select("target", F.explode(ways).alias("c")).select("c.key", "c.way", "target")


def folders(files: DataFrame) -> DataFrame:
    """(key) of all directories that hold files, at any depth."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.where(F.size(parts) > 1).select(F.explode(above).alias("key")).distinct()


def matched(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (src, dst, relation, confidence, provenance) from the ``candidates`` of imports among ``files`` (path).

    Of an import's candidates the best that is there counts; one that only
    letter case tells from a file counts where none is there as written.
    """
    keys = file_keys(files).select(F.lower("key").alias("lc"), F.col("key").alias("written"), "way", "target", F.lit(False).alias("folder"))
    keys = keys.unionByName(folders(files).select(F.lower("key").alias("lc"), F.col("key").alias("written"), F.lit(0).alias("way"), F.col("key").alias("target"), F.lit(True).alias("folder")))
    rank = F.col("rank") + F.col("way") + F.when(F.col("key") == F.col("written"), 0).otherwise(_OTHER_CASE)
    hits = wanted.withColumn("lc", F.lower("key")).join(keys, ["lc", "folder"]).select("src", "ext", "source", "relation", "part", rank.alias("rank"), "target", "folder")
    best = hits.groupBy("src", "ext", "source", "relation", "part").agg(F.min_by(F.struct("target", "folder"), F.struct("rank", "target")).alias("b"))
    best = materialized(best.where("not b.folder or ext = '.go'").select("src", "ext", "relation", "b.target", "b.folder"), "matched")
    found = distinct_links(best.where("not folder").select("src", F.col("target").alias("dst"), "relation"))
    # A package of Go is a directory: an import of it depends on every file in there.
    packages = best.where("folder").select("src", F.col("target").alias("dir"), "relation").distinct()
    if packages.isEmpty():
        return described(found)
    # The files of a directory differ, so pairs with them are distinct as they are made; only files imported by name as well are told apart, before that.
    inside = files.where(F.col("path").endswith(".go")).select(folder_of(F.col("path")).alias("dir"), F.col("path").alias("dst")).distinct()
    alone = found.withColumn("dir", F.when(F.col("dst").endswith(".go"), folder_of(F.col("dst")))).join(packages, ["src", "dir", "relation"], "left_anti").select("src", "dst", "relation")
    fan = pairs(packages, inside, "dir").where("src <> dst").select("src", "dst", "relation")
    return described(alone.unionByName(fan))


def resolved(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None, module: str | None = None, crates: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """Edges of ``imports`` (path, ext, source, type, dynamic) among ``files`` (path)."""
    return matched(candidates(imports, files, packages, module, crates, parity), files)


def distinct_links(links: DataFrame) -> DataFrame:
    """(src, dst, relation) of ``links`` between different files, each once."""
    return links.where("src <> dst").select("src", "dst", "relation").distinct()


def described(links: DataFrame) -> DataFrame:
    """Edges of distinct ``links`` (src, dst, relation), with confidence and provenance."""
    confidence = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("relation"))
    provenance = F.when(F.col("relation") == "imports:dynamic", "dynamic_analysis").otherwise("static_analysis")
    return links.withColumn("confidence", confidence).withColumn("provenance", provenance)


def as_edges(links: DataFrame) -> DataFrame:
    """Distinct edges (src, dst, relation) between different files, with confidence and provenance."""
    return described(distinct_links(links))
