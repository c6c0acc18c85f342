"""Approximate nearest neighbours: multiprobe p-stable hashing, then exact distances."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import finite, search
from .common import table

K = 10
QUERY_STEP = 100
#: Tables, projections of each, their width in units of the vectors' mean distance.
TABLES, PROJECTIONS, WIDTH = 32, 4, 0.8
#: Perturbed buckets of a table, rows met with repeats and rows whose distance is taken, in units of a shard's rows.
PROBES, MET, SHARE = 80, 8, 0.25
SEED = 20
#: Rows of a shard from which the mean distance is taken.
SAMPLE = 256


def perturbations(count: int, m: int = PROJECTIONS) -> list[list[int]]:
    """The first ``count`` sets of boundaries to cross, by expected score; boundary i of 2m is the i-th nearest.

    The expected squared distance to the i-th nearest of 2m boundaries follows
    from order statistics of uniform offsets.  Sets that cross both boundaries
    of one projection are left out.
    """
    score = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    heap, out = [(score[0], [0])], [[]]
    while heap and len(out) < count:
        s, a = heappop(heap)
        if all(2 * m - 1 - j not in a for j in a):
            out.append(a)
        last = a[-1]
        if last + 1 < 2 * m:
            heappush(heap, (s - score[last] + score[last + 1], [*a[:-1], last + 1]))
            heappush(heap, (s + score[last + 1], [*a, last + 1]))
    return out


class Buckets:
    """The buckets of all tables of a shard's vectors, every row in one bucket of each table."""

    def __init__(self, vectors: np.ndarray):
        self.n, dims = vectors.shape
        m = PROJECTIONS
        rng = np.random.default_rng(SEED)
        sample = vectors[np.linspace(0, self.n - 1, min(self.n, SAMPLE)).astype(int)]
        self.width = WIDTH * (np.sqrt(2 * np.var(sample, axis=0).sum()) or 1.0)
        # As far as there are dimensions, no projection repeats what others tell.
        turns = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] * np.sqrt(dims) for _ in range(-(-TABLES * m // dims))]
        self.axes = np.concatenate(turns, axis=1)[:, : TABLES * m]
        self.shift = rng.random(TABLES * m)
        self.odd = rng.integers(1, 2**62, m) * 2 + 1  # a bucket's code; rows of two buckets of one code are both met
        self.of_table = rng.integers(1, 2**62, (TABLES, 1)) * 2 + 1
        codes = (self._cells(vectors).astype(np.int64) @ self.odd + self.of_table.T).T.ravel()
        order = np.argsort(codes, kind="stable")
        self.codes, self.starts, self.sizes = np.unique(codes[order], return_index=True, return_counts=True)
        self.rows = order % self.n
        sets = perturbations(PROBES, m)
        self.crossed = np.zeros((len(sets), 2 * m))
        for i, a in enumerate(sets):
            self.crossed[i, a] = 1
        self.crossed_int = self.crossed.astype(np.int64)

    def _places(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.axes / self.width + self.shift).reshape(-1, TABLES, PROJECTIONS)

    def _cells(self, vectors: np.ndarray) -> np.ndarray:
        return np.floor(self._places(vectors))

    def candidates(self, query: np.ndarray, least: int) -> np.ndarray | None:
        """The rows to be compared with a query, a SHARE of all or ``least``; None if it meets too few to tell.

        Buckets of all tables are visited in the order of estimated success,
        by the squared distances to the boundaries that are crossed to get
        there, until MET times all rows were met.  What tables say of a row
        is added up: it weighs more the nearer the buckets that it was met in.
        """
        at = self._places(query[None])[0]
        base = np.floor(at)
        reach = np.concatenate([at - base, 1 - at + base], axis=1)
        near = np.argsort(reach, axis=1, kind="stable")
        scores = (np.take_along_axis(reach, near, 1) ** 2 @ self.crossed.T).ravel()
        steps = np.concatenate([-self.odd, self.odd])[near]
        keys = (base.astype(np.int64) @ self.odd[:, None] + self.of_table + steps @ self.crossed_int.T).ravel()
        found = np.minimum(np.searchsorted(self.codes, keys), len(self.codes) - 1)
        there = np.flatnonzero(self.codes[found] == keys)
        there = there[np.argsort(scores[there], kind="stable")]
        found, scores = found[there], scores[there]
        met = np.cumsum(self.sizes[found])
        if not len(met) or met[-1] < MET * self.n / 2:
            return None
        upto = int(np.searchsorted(met, MET * self.n)) + 1
        found, sizes = found[:upto], self.sizes[found[:upto]]
        rows = self.rows[np.repeat(self.starts[found] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        weight = np.bincount(rows, np.repeat(np.exp(-scores[:upto] * WIDTH**2), sizes), self.n)
        share = max(int(SHARE * self.n), least)
        best = np.argpartition(-weight, share)[:share] if share < self.n else np.arange(self.n)
        return best[weight[best] > 0]


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest rows found for each query, its own id left out; ``ids`` ascend.

    The distances of a query's candidates are exact.  A query that meets too few
    rows in all its buckets lies far from them, and is held against every row,
    as is every query of a shard of few rows.
    """
    n = len(ids)
    buckets = Buckets(vectors) if n > 16 * k else None
    out_q, out_d, out_s = [], [], []
    for qid, q in zip(query_ids.tolist(), queries):
        rows = buckets.candidates(q, 8 * k) if buckets else None
        rows = np.flatnonzero(ids != qid) if rows is None else rows[ids[rows] != qid]
        if len(rows) < k:
            rows = np.flatnonzero(ids != qid)
        d2 = ((vectors[rows] - q) ** 2).sum(axis=1)
        if len(rows) > k:
            keep = d2 <= np.partition(d2, k - 1)[k - 1]
            rows, d2 = rows[keep], d2[keep]
        order = np.lexsort((ids[rows], d2))[:k]
        out_q += [qid] * len(order)
        out_d += ids[rows[order]].tolist()
        out_s += np.sqrt(d2[order]).tolist()
    return np.array(out_q, np.int64), np.array(out_d, np.int64), np.array(out_s)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, **sizes) -> DataFrame:
    """The ``k`` nearest rows found for each of ``queries`` among ``vectors``, both (vec_id, v), by Euclidean distance.

    Zero vectors, nulls and vectors with null or non-finite components must be
    left out before.  Rows of equal id are rows of their own, but none is found
    for a query of its id.  Of equal distances the smaller id comes first, also
    if vectors are repeated.  Other columns must not be there (``finite`` leaves
    them out).  Without rows or queries the result is empty.
    """
    return search(vectors, queries, lambda a, b, c, d: nearest(a, b, c, d, k), k, "double", False, "pstable", **sizes)


def op4_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows near every hundredth row; rows without a vector that can be measured take no part, whatever else they hold."""
    vectors = finite(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").where(F.exists("v", lambda x: x != 0))
    return nearest_neighbours(vectors, vectors.where(F.pmod("vec_id", F.lit(QUERY_STEP)) == 0))
