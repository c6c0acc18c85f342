"""Tasks and rules that people record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import RECENT


def appended(table: DataFrame, **values) -> DataFrame:
    """``table`` with one more row: the next id, now, and ``values``."""
    row = table.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    for name, kind in table.dtypes:
        if name == "id":
            continue
        value: Column = F.current_timestamp() if name == "created_at" else F.lit(values.get(name)).cast(kind)
        row = row.withColumn(name, value)
    return table.unionByName(row.select(table.columns))


def removed(table: DataFrame, id: int) -> DataFrame:
    return table.where(F.col("id") != id)


def recent(table: DataFrame, n: int | None = RECENT) -> DataFrame:
    """Latest first; of one moment the last recorded first."""
    out = table.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return out if n is None else out.limit(n)
