"""Exact top-k by MaxScore over sharded inverted lists of vector components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import finite, search
from .common import table

K = 5
SCALE = 256
QUERY_STEP = 50
#: Lists of a first look, and lists probed between two looks at which rows are still competitive.
FIRST, STRIDE = 12, 4


def postings(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverted lists and their largest entries: column 2d has the positive values of component d, 2d+1 the sizes of the negative ones.

    Half of all rows are in a list on average, so lists are kept as columns.
    """
    lists = np.empty((vectors.shape[1] * 2, len(vectors)), vectors.dtype)
    lists[0::2] = np.maximum(vectors, 0).T
    lists[1::2] = np.maximum(-vectors, 0).T
    return lists, lists.max(axis=1, initial=0)


def maxscore(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows of largest inner product with each query, its own id left out; ``ids`` ascend.

    A query's terms are the lists in which its component meets one of its own
    sign, in order of their largest contribution; lists of the other sign
    contribute less than nothing.  The best of a first look give a k-th score.
    The essential lists, without which no row can reach that, are added up over all
    rows; then only rows still competitive are probed in the others, a few
    lists at a time, and those that can no longer reach it go.
    """
    # Products and sums stay exact in double precision up to 2^53; beyond that, Python integers are used.
    exact = np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * vectors.shape[1] < 2.0**53
    if not exact:
        vectors, queries = (np.vectorize(int, otypes=[object])(x) for x in (vectors, queries))
    lists, most = postings(vectors)
    dims = vectors.shape[1]
    out_q, out_d, out_s = [], [], []
    for qid, q in zip(query_ids.tolist(), queries):
        terms = 2 * np.arange(dims) + (q < 0)
        weights = np.abs(q)
        bound = weights * most[terms]
        order = np.argsort(-bound.astype(float), kind="stable")
        order = order[bound[order] > 0]
        terms, weights, bound = terms[order], weights[order], bound[order]
        left = np.append(np.cumsum(bound[::-1])[::-1], 0)  # what the lists from i on can add
        other = np.flatnonzero(ids != qid)
        scores = weights[:FIRST] @ lists[terms[:FIRST]] if len(terms) else np.zeros(len(ids), vectors.dtype)
        alive = other
        if len(other) > 4 * k:
            first = scores[other].astype(float)
            guess = other[np.argpartition(-first, 4 * k)[: 4 * k]]
            floor = np.sort(vectors[guess] @ q)[-k]
            i = max(min(FIRST, len(terms)), int(np.count_nonzero(left[:-1] >= floor)))
            scores = scores + weights[FIRST:i] @ lists[terms[FIRST:i]] if i > FIRST else scores
            alive = other[scores[other] + left[i] >= floor]
            scores = scores[alive]
            while i < len(terms) and len(alive) > 4 * k:
                for t, w in zip(terms[i : i + STRIDE], weights[i : i + STRIDE]):
                    scores = scores + w * lists[t][alive]
                i = min(i + STRIDE, len(terms))
                keep = scores + left[i] >= floor
                alive, scores = alive[keep], scores[keep]
        final = vectors[alive] @ q
        if len(alive) > k:
            keep = final >= np.sort(final)[-k]
            alive, final = alive[keep], final[keep]
        top = sorted(zip([-int(x) for x in final], ids[alive].tolist()))[:k]
        out_q += [qid] * len(top)
        out_d += [d for _, d in top]
        out_s += [-s for s, _ in top]
    return np.array(out_q, np.int64), np.array(out_d, np.int64), np.array(out_s, np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, **sizes) -> DataFrame:
    """The ``k`` largest inner products of each of ``queries`` with all ``vectors``, both (vec_id, v).

    Components become floor(scale * x).  Vectors that are null, empty, or hold
    null or non-finite components must be left out before (``finite``); with no
    rows or no queries the result is empty.  Rows of equal id are rows of their
    own, but none is compared with a query of its id.  Of equal scores the smaller id comes
    first.  Other columns must not be there (``finite`` leaves them out, whatever
    they are called).  Scores beyond 64 bits are an error.
    """
    whole = lambda df: df.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    return search(whole(vectors), whole(queries), lambda a, b, c, d: maxscore(a, b, c, d, k), k, "bigint", True, "maxscore", **sizes)


def op2_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth row; rows without a finite vector take no part."""
    vectors = finite(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(QUERY_STEP)) == 0))


OP2_SQL = """
WITH e AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
