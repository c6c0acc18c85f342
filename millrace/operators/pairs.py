"""All pairs of rows that share a key, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block; a block of each side makes a tile of its square in pairs.
BLOCK_ROWS = 1024
#: Pairs up to which one task may have them all, and pairs of a task beyond that, about.
TASK_PAIRS = 4_000_000


def numbered(rows: DataFrame, key: str, block: str, block_rows: int) -> DataFrame:
    """``rows`` with the number of their ``block``, of which each has ``block_rows`` rows of one key at most.

    Rows of a large key are dealt into shares by hash first, so that no key is
    numbered whole in one task; equal rows follow one another in their share.
    """
    values = [c for c in rows.columns if c != key]
    large = rows.groupBy(key).agg(F.ceil(F.count("*") / block_rows).alias("_shares")).where("_shares > 1")
    dealt = rows.join(large, key, "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64(*values), F.col("_shares")), F.lit(0)))
    at = F.row_number().over(Window.partitionBy(key, "_share").orderBy(*values)) - 1
    return dealt.withColumn(block, F.struct("_share", F.floor(at / block_rows).alias("_part"))).select(key, block, *values)


def pairs(left: DataFrame, right: DataFrame, key: str, block_rows: int | None = None, task_pairs: int | None = None) -> DataFrame:
    """All pairs of rows of ``left`` and ``right`` with the same ``key``, as a join gives them, without ``key``.

    Pairs grow with the square of a key's rows, and a join leaves all pairs of a
    key to one task.  So they are counted first, and many are dealt out by
    tiles: a block of rows of one side with a block of the other.
    """
    block_rows, task_pairs = block_rows or BLOCK_ROWS, task_pairs or TASK_PAIRS
    left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    sizes = left.groupBy(key).agg(F.count("*").cast("double").alias("_n")).join(right.groupBy(key).agg(F.count("*").alias("_m")), key)
    total = sizes.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
    if total <= task_pairs:
        return left.join(right, key).drop(key)
    ours, theirs = ([c for c in side.columns if c != key] for side in (left, right))
    a, b = numbered(left, key, "_a", block_rows), numbered(right, key, "_b", block_rows)
    members = b.groupBy(key, "_b").agg(F.collect_list(F.struct(*theirs)).alias("_members"))
    tasks = int(-(-total // task_pairs))
    # A row meets each block of the other side once; the block's rows are unrolled beside it.
    rows = a.join(b.select(key, "_b").distinct(), key).repartition(tasks, key, "_a", "_b")
    tiles = members.join(a.select(key, "_a").distinct(), key).repartition(tasks, key, "_a", "_b")
    met = rows.join(tiles, [key, "_a", "_b"])
    return met.select(*ours, F.explode("_members").alias("_member")).select(*ours, "_member.*")
