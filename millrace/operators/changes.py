"""What changed between a scan and the stored tables, and tables without or with what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(scanned: DataFrame, stored: DataFrame, embeds: bool = False) -> DataFrame:
    """(path, status): new, changed, retry, unchanged or removed, by content hash.

    A stored file that is stale or has no summary, or no embedding if ``embeds``, is tried again.
    """
    a, b = scanned.select("path", F.col("content_hash").alias("now")), stored.select("path", F.col("content_hash").alias("then"), "stale", "summary", *(["embedding"] if embeds else []))
    both = a.join(b, "path", "full_outer")
    retry = F.coalesce("stale", F.lit(False)) | (F.coalesce("summary", F.lit("")) == "")
    if embeds:
        retry |= F.col("embedding").isNull()
    status = F.when(F.col("now").isNull(), "removed").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "changed").when(retry, "retry").otherwise("unchanged")
    return both.select("path", status.alias("status"))


def replaced(stored: DataFrame, paths: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """``stored`` with the rows of ``paths`` (path) replaced by ``fresh`` ones."""
    return stored.join(paths.select(F.col("path").alias(key)), key, "left_anti").unionByName(fresh)


def without(stored: DataFrame, paths: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``stored`` without rows that name one of ``paths`` under any of ``keys``: a delete with its cascade."""
    for key in keys:
        stored = stored.join(paths.select(F.col("path").alias(key)), key, "left_anti")
    return stored


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, name): added names as often as they are new, removed names once."""
    keys = ["path", "name"]
    added = after.join(before.select(keys).distinct(), keys, "left_anti").select("path", F.lit("added").alias("change"), "name")
    removed = before.join(after.select(keys).distinct(), keys, "left_anti").select("path", F.lit("removed").alias("change"), "name").distinct()
    return added.unionAll(removed)
