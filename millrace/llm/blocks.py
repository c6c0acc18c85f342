"""A stated set of queries against all rows, in blocks.

Rows are dealt into shards and queries into blocks; every pair of a shard and a
block is a task of bounded size, reached by an ordinary join on the pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a shard and queries of a block, about; a shard of 64 float64 components is 4 MB, a block 16 MB.
SHARD_ROWS, BLOCK_ROWS = 8192, 32_768


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def search(
    vectors: DataFrame, queries: DataFrame, best: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, score: str, descending: bool, seed: str, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each of ``queries``, both (vec_id, v), by ``best`` of every shard.

    ``best(ids, vectors, query_ids, queries)`` gives query ids, row ids and
    scores of one shard's best.  Ties go to smaller ids.
    """
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    task = lambda s, b: F.struct(s.cast("int").alias("s"), b.cast("int").alias("b"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    left = vectors.withColumn("s", own(shards)).withColumn("b", every(blocks)).select(task(F.col("s"), F.col("b")).alias("task"), "vec_id", "v")
    right = queries.withColumn("b", own(blocks)).withColumn("s", every(shards)).select(task(F.col("s"), F.col("b")).alias("task"), "vec_id", "v")

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            q = d = np.zeros(0, np.int64)
            s = np.zeros(0)
        else:
            rows = rows.sort_values("vec_id", kind="stable")
            q, d, s = best(rows["vec_id"].to_numpy(), matrix(rows["v"]), asked["vec_id"].to_numpy(), matrix(asked["v"]))
        return pd.DataFrame({"query_id": q, "vec_id": d, "score": s})

    found = left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(run, f"query_id bigint, vec_id bigint, score {score}")
    order = F.col("score").desc() if descending else F.col("score").asc()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows whose vector is there and has only finite components."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & good)
