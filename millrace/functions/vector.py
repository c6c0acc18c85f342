"""Vectors: cosine distance and a stand-in embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector has no length."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hashed_embedder(size: int = 128) -> Embedder:
    """Bags of hashed words, of length one: the same for the same text anywhere, but no model of language."""
    import re

    import xxhash

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(size, np.float32)
            for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
                h = xxhash.xxh64_intdigest(w)
                v[h % size] += 1 if h >> 63 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out

    return embed


def embedded(df: DataFrame, text: str, embedder: Embedder | None, name: str = "embedding") -> DataFrame:
    """``df`` with the embedding of a text column; null without an embedder."""
    if embedder is None:
        return df.withColumn(name, F.lit(None).cast("array<float>"))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embedder(texts.fillna("").tolist()))

    return df.withColumn(name, run(F.col(text)))


def nearest(vectors: DataFrame, query: Column | list[float], k: int = 10, key: str = "path", vector: str = "embedding") -> DataFrame:
    """(key, distance) of the ``k`` rows nearest to one vector; only the k best of each task are moved."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(vector).isNotNull()).select(key, cosine_distance(F.col(vector), q).alias("distance")).where("distance is not null").orderBy("distance", key).limit(k)
