"""Vectors, shards, mixing, the classifier and the pipeline, against plain versions or SQL."""

import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import blocks, common, maxscore, mixing, pstable, sharding
from millrace.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLE_SQL[name], connect(SF)) is None


def test_entry_has_every_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


COLUMNS = {
    "op1_": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint", "op2_": "query_id:bigint rank:int vec_id:bigint score:bigint", "op3_": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    "op4_": "query_id:bigint rank:int vec_id:bigint score:double", "op5_": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint", "op6_": "doc_id:bigint lang:string tokens:bigint perplexity:double threshold:double keep:boolean",
    "op7_": "doc_id:bigint n_lines:bigint n_removed:bigint n_near:bigint kept_crc32:bigint", "op8_": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int", "op9_": "doc_id:bigint fingerprint:string component_id:bigint",
    "op10_": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint", "op11_": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op12_": "conv_id:bigint depth:bigint parent_conv_id:bigint n_convs:bigint n_children:bigint n_leaves:bigint saved_tokens:bigint ends_sha256:string",
    "op13_": "lang:string rank:bigint phrase:string a:bigint l:bigint r:bigint n:bigint score:bigint",
}


@pytest.mark.parametrize("prefix", sorted(COLUMNS))
def test_queries_return_what_they_must(spark, prefix):
    """Columns and types of the registered queries, over every row."""
    (query,) = (q for n, q in QUERIES.items() if n.startswith(prefix))
    df = query(spark, SF)
    assert " ".join(f"{c}:{t}" for c, t in df.dtypes) == COLUMNS[prefix]
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.count() == docs if prefix not in ("op2_", "op4_", "op5_", "op12_", "op13_") else df.count() > 0


def vectors(spark, rows):
    return blocks.finite(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")


ODD = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [])]


def test_finite(spark):
    assert vectors(spark, ODD).count() == 0


@pytest.mark.parametrize("scale", [1, 1e6])
def test_maxscore(spark, scale):
    rnd = np.random.default_rng(5)
    data = [(i, (np.round(rnd.standard_normal(8), 1 if i % 3 else 2) * scale).tolist()) for i in range(300)] + ODD
    data += [(400 + i, data[0][1]) for i in range(8)]  # ties
    v = vectors(spark, data)
    got = sorted(map(tuple, maxscore.top_k(v, v.where("vec_id % 50 = 0"), shard_rows=100, block_rows=3).collect()))
    whole = {i: [int(np.floor(256 * y)) for y in x] for i, x in data if i is not None and x and all(y is not None and np.isfinite(y) for y in x)}
    want = []
    for q in whole:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got == sorted(want)


def test_few_vectors(spark):
    v = vectors(spark, [(0, [1.0, 2.0]), (7, [0.5, 0.5])])
    assert [tuple(r) for r in maxscore.top_k(v, v.where("vec_id = 0")).collect()] == [(0, 1, 7, 256 * 128 + 512 * 128)]
    assert [r["vec_id"] for r in pstable.nearest_neighbours(v, v.where("vec_id = 0")).collect()] == [7]
    none = vectors(spark, ODD)
    assert maxscore.top_k(none, none).count() == 0 and pstable.nearest_neighbours(none, none).count() == 0


def test_neighbours_recall(spark):
    found = pstable.op4_multiprobe_neighbours(spark, "/root/testdata/sf0.1").collect()
    x = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    m, ids = np.array(x.embedding.tolist(), np.float64), x.vec_id.to_numpy()
    hits, total = 0, 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - m[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r[0] for r in got] == list(range(1, 11))
        assert all(abs(d[ids == i][0] - s) < 1e-12 for _, i, s in got)
        hits += len({i for _, i, _ in got} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        total += 10
    assert hits / total >= 0.9


@pytest.mark.parametrize("name", ["edges", "clashing", "nothing"])
def test_shards(request, name):
    docs = request.getfixturevalue(name)
    got = sharding.balanced_shards(docs).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(want)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(24)) and max(counts.values(), default=0) - min([counts[s] for s in range(24)]) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())


def test_shards_keep_copies_together(spark):
    docs = spark.createDataFrame([(i, f"text {i // 5 if i < 600 else i}") for i in range(2400)] + [(i, "hot") for i in range(3000, 4200)], "doc_id long, text string")
    got = sharding.balanced_shards(docs).toPandas()
    assert got.groupby("shard").size().agg(["min", "max"]).tolist() == [150, 150]
    texts = docs.toPandas().merge(got, on="doc_id")
    groups = texts[texts.doc_id < 600].groupby("text").shard.nunique()
    assert (groups == 1).mean() > 0.9
    # Copies of one text that fill a third of all take the fewest shards that hold them, or a few more.
    assert texts[texts.text == "hot"].shard.nunique() < 24


@pytest.mark.parametrize("name", ["edges", "clashing", "nothing", "sf"])
def test_mix(spark, request, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if name == "sf" else request.getfixturevalue(name)
    got = mixing.mix(docs).collect()
    sizes, order = Counter(), sorted({r["source"] for r in docs.collect()}, key=lambda s: (s is None, s or ""))
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, total = {}, set(order), sum(sizes.values())
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: float(3 * sizes[s]) for s in over}
        free -= set(over)
    taken = Counter()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    assert len(got) == docs.count()
    table = mixing.repeated(docs)
    assert table.columns == docs.columns
    assert table.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == (sum(taken.values()) or None)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))


def test_running_sum(spark):
    rows = [(i % 3 or None, i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, id int, v int")
    got = common.running_sum(df, F.col("v"), F.xxhash64("id"), ["id"], ["k"], "before", bits=3).select("k", "v", "before", F.xxhash64("id").alias("h")).collect()
    for k in (None, 1, 2):
        total = 0
        for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["h"] % 2**64):
            assert r["before"] == total
            total += r["v"]


@pytest.mark.parametrize("name", ["edges", "clashing", "nothing"])
def test_pipeline_stages_over_awkward_rows(spark, request, name):
    docs = request.getfixturevalue(name)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = common.written(out, "stage")
    assert out.count() > 0 or name == "nothing"


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    sizes = out.groupby("sequence_id").length.sum()
    assert sizes.max() <= 1024 and sizes.sum() / (1024 * len(sizes)) > 0.95
