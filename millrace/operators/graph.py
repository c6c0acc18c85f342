"""Queries over the dependency graph: edges (src, dst, relation), src depends on dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import UNRESOLVABLE
from ..sources.store import materialized

MAX_DEPTH = 100_000
#: Levels after which what was visited is written as one table, so that its plan stays short.
COMPACT = 8


def closure(edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(origin, node, depth) of all that reaches each of ``starts`` (origin, node) over ``edges`` backwards, the starts at depth 0.

    One round a level: the frontier meets the edges, and what was met before
    drops out, so cycles end.  Every level is written to the shared folder, which
    cuts the lineage, and every few levels they are written as one.  A graph
    deeper than ``max_depth`` is an error.
    """
    # Written once: every level reads it, and where edges come from may be a long plan.
    back = materialized(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct(), "edges")
    frontier = materialized(starts.select("origin", "node").distinct().withColumn("depth", F.lit(0)), "level")
    visited = frontier
    for depth in range(1, max_depth + 2):
        met = frontier.select("origin", "node").join(back, "node").select("origin", F.col("next").alias("node")).distinct()
        frontier = materialized(met.join(visited, ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)
        if depth % COMPACT == 0:
            visited = materialized(visited, "visited")
    raise RuntimeError(f"the graph is deeper than {max_depth} levels")


def blast_radius(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(origin, path, depth, unresolvable) of all that a change of each start may break.

    Plain imports are followed.  Files that import something reached only dynamically are
    flagged, one hop on, and not followed; type imports do not count.  The
    start itself is no result, though it may be flagged.
    """
    nodes = closure(edges.where("relation = 'imports'"), starts)
    plain = nodes.where("depth > 0").select("origin", F.col("node").alias("path"), "depth", F.lit(False).alias("unresolvable"))
    dynamic = edges.where("relation = 'imports:dynamic'").select("src", F.col("dst").alias("node"))
    flagged = nodes.join(dynamic, "node").groupBy("origin", "src").agg((F.min("depth") + 1).cast("int").alias("depth"))
    return plain.unionByName(flagged.select("origin", F.col("src").alias("path"), "depth", F.lit(True).alias("unresolvable")))


def shown(path: str = "path") -> Column:
    return F.when(F.col("unresolvable"), F.concat(F.lit(UNRESOLVABLE), F.col(path))).otherwise(F.col(path))


def direct_dependents(edges: DataFrame, path: str | Column) -> DataFrame:
    """(path) of the files one hop away, over any relation; the case of ``path`` does not count."""
    return edges.where(F.lower("dst") == F.lower(F.lit(path) if isinstance(path, str) else path)).select(F.col("src").alias("path")).distinct()


def is_test(path: Column) -> Column:
    return path.contains(".test.") | path.contains(".spec.")


def radius_size(found: DataFrame) -> DataFrame:
    """(origin, size): how many files each start's blast radius has, flagged ones included."""
    return found.groupBy("origin").agg(F.count_distinct("path").alias("size"))


def related_tests(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(path) of the tests in the blast radius of any of ``starts``."""
    return blast_radius(edges, starts).where(is_test(F.col("path"))).select("path").distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree): edges in and out; nodes without edges have none."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return ends if nodes is None else nodes.join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def graph_links(edges: DataFrame) -> DataFrame:
    return edges.where("relation = 'imports'").select(F.col("src").alias("source"), F.col("dst").alias("target"))


def graph_nodes(edges: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes of the plain import graph with what their files hold; files without edges are left out."""
    links = graph_links(edges)
    ends = links.select(F.col("source").alias("path")).union(links.select("target")).distinct()
    counts = symbols.groupBy("path").agg(
        F.count("*").alias("n"), F.count_if(F.col("type") == "function").alias("functions"), F.count_if(F.col("type") == "class").alias("classes"), F.count_if(F.col("type").isin("variable", "const")).alias("variables")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    label = F.element_at(F.split("path", "/"), -1)
    return files.join(ends, "path", "left_semi").join(counts, "path", "left").select(F.col("path").alias("id"), label.alias("label"), "path", "summary", "stale", zero("n").alias("symbolCount"), F.struct(*[zero(c).alias(c) for c in ("functions", "classes", "variables")]).alias("breakdown"))


def graph_label(path: Column) -> Column:
    """A node's short name; an index file shows its directory too."""
    name = F.element_at(F.split(path, "/"), -1)
    parent = F.try_element_at(F.split(path, "/"), F.lit(-2))
    return F.when(name.startswith("index.") & parent.isNotNull(), F.concat(parent, F.lit("/"), name)).otherwise(name)
