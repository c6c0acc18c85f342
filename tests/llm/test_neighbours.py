"""Neighbours against brute force: recall and what it costs, shards, ties, repeated rows, clashing columns."""

import numpy as np

from millrace.llm import pstable


def test_outliers_find_their_nearest_rows():
    rnd = np.random.default_rng(8)
    bulk = rnd.standard_normal((3000, 32))
    far = rnd.standard_normal((6, 32)) * np.array([[20], [10], [100], [1000], [50], [50]])
    far[5] = far[4] + 0.01  # a distant pair, fewer than the rows asked for
    v = np.concatenate([bulk, far])
    v /= np.linalg.norm(bulk, axis=1).mean()
    ids = np.arange(len(v))
    q, found, score = pstable.nearest(ids, v, ids[3000:], v[3000:])
    for i in ids[3000:]:
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert found[q == i].tolist() == np.lexsort((ids, d))[:10].tolist()


def brute(v, ids, queries, k=10):
    out = {}
    for i in queries:
        d = np.sqrt(((v - v[ids == i][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(ids[j], d[j]) for j in order]
    return out


def test_recall_and_cost(spark):
    """Over one shard and over several a quarter of the rows is compared, and at least nine in ten neighbours are found."""
    x = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    v, ids = np.array(x.embedding.tolist(), np.float64), x.vec_id.to_numpy()
    want = brute(v, ids, ids[ids % 20 == 0].tolist())
    for shards in (1, 4):
        hits = cost = 0
        found = {i: [] for i in want}
        for s in range(shards):
            own = np.flatnonzero(ids % 7 % shards == s)
            buckets = pstable.Buckets(v[own])
            cost += sum(len(buckets.candidates(v[ids == i][0], 80)) for i in want)
            q, d, score = pstable.nearest(ids[own], v[own], np.array(list(want)), np.array([v[ids == i][0] for i in want]))
            for a, b, c in zip(q.tolist(), d.tolist(), score.tolist()):
                found[a].append((c, b))
        for i, best in want.items():
            hits += len({d for _, d in sorted(found[i])[:10]} & {j for j, _ in best})
        assert hits / (10 * len(want)) >= 0.92
        assert cost <= 0.26 * len(ids) * len(want)


def test_ties_repeats_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from millrace.llm import blocks

    rnd = np.random.default_rng(1)
    base = rnd.integers(-2, 3, (40, 4)).astype(float)
    data = [(i, base[i % 40].tolist()) for i in range(130)] + [(7, base[3].tolist()), (7, base[7].tolist()), (8, [0.0] * 4), (9, None), (None, [1.0] * 4)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("v", "s", "b", "task", "rank", "score", "query_id")])
    rows = blocks.finite(df, "vec_id", "embedding").where(F.exists("v", lambda x: x != 0))
    got = pstable.nearest_neighbours(rows, rows.where("vec_id % 100 = 0"), shard_rows=30, block_rows=1).collect()
    from millrace.llm import maxscore

    every = blocks.finite(df, "vec_id", "embedding")
    best = maxscore.top_k(every, every.where("vec_id % 50 = 0"), shard_rows=30, block_rows=1).collect()
    whole = [(i, [256 * int(y) for y in x]) for i, x in data if i is not None and x]
    for q in (0, 50, 100):
        own = [256 * int(y) for y in base[q % 40]]
        ranked = sorted((-sum(a * b for a, b in zip(own, x)), i) for i, x in whole if i != q)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in best if r["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    kept = [(i, x) for i, x in data if i is not None and x and any(x)]
    for q in (0, 100):
        d = sorted((float(np.sqrt(((np.array(x) - base[q % 40]) ** 2).sum())), i) for i, x in kept if i != q)[:10]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(k + 1, i, s) for k, (s, i) in enumerate(d)]
