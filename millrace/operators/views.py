"""Tables behind the pages of a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FILES_SHOWN, RECENT


def stats(files: DataFrame, symbols: DataFrame, edges: DataFrame, tasks: DataFrame, rules: DataFrame) -> DataFrame:
    """One row of counts."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = files.agg(F.count("*").alias("files"), F.count_if("stale").alias("stale"))
    for df, name in ((symbols, "symbols"), (edges, "edges"), (tasks, "tasks"), (rules, "rules")):
        out = out.crossJoin(count(df, name))
    return out


def memory(files: DataFrame, symbols: DataFrame, n: int = RECENT) -> DataFrame:
    """The first files by path, each with its symbols in order."""
    shown = files.orderBy("path").limit(n)
    held = symbols.join(shown.select("path"), "path", "left_semi").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_line", "name", "type"))).alias("symbols"))
    return shown.join(held, "path", "left").select("path", "summary", F.coalesce("symbols", F.array().cast("array<struct<start_line:int,name:string,type:string>>")).alias("symbols")).orderBy("path")


def file_list(files: DataFrame, n: int = FILES_SHOWN) -> DataFrame:
    return files.select("path", "summary", "stale", "last_indexed").orderBy("path").limit(n)


def pass_rate(results: DataFrame) -> DataFrame:
    """Share of passed rows (passed boolean), in percent."""
    return results.agg((F.avg(F.col("passed").cast("double")) * 100).alias("percent"))


def fixture_sets(cases: DataFrame) -> DataFrame:
    """(fixture, missing, extra, forbidden, passed) of ``cases`` (fixture, expected, unresolvable, banned, actual: arrays of paths).

    Case does not count.  Missing are expected paths that were not found, extra
    are found ones that nobody expected, forbidden are found ones that must not be.
    """
    low = {c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x)) for c in ("expected", "unresolvable", "banned", "actual")}
    missing = F.array_sort(F.array_except(low["expected"], low["actual"]))
    extra = F.array_sort(F.array_except(low["actual"], F.concat(low["expected"], low["unresolvable"])))
    forbidden = F.array_sort(F.array_intersect(low["banned"], low["actual"]))
    return cases.select("fixture", missing.alias("missing"), extra.alias("extra"), forbidden.alias("forbidden"), ((F.size(missing) == 0) & (F.size(forbidden) == 0)).alias("passed"))


def warned(files: DataFrame, by: str) -> DataFrame:
    """(by, warned, n): whether any file of a group is stale."""
    return files.groupBy(by).agg(F.bool_or("stale").alias("warned"), F.count("*").alias("n"))


def shown(df: DataFrame, most: int, order: list) -> tuple[list, int]:
    """The first rows in an order, and how many more there are."""
    total = df.count()
    return df.orderBy(*order).limit(most).collect(), max(0, total - most)


def match_percent(distance: Column) -> Column:
    """A neighbour's distance as a share in percent, as people read it."""
    return F.greatest(F.lit(0), F.round((1 - distance) * 100).cast("int"))
