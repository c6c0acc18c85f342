"""MinHash near-dedup: one-permutation sketches with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, short_batches, small, table, written
from .components import components
from .shingles import SIMILARITY, _compared, _mixed, shingles

#: Words of a shingle.
WORDS = 4
#: Bands of so many bins each.  A pair at similarity 0.8 has no band in common with a probability of about
#: (1 - 0.8^4)^40 = 6e-10, and of less than 1e-6 where few bins are filled or many shingles share one.
BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
#: Members of a star, or of a bucket that stars leave open, that meet in one group.
BLOCK = 512
BROADCAST_ROWS = 1_000_000


def _probes() -> np.ndarray:
    """For each bin the order in which an empty one looks at all bins; the first is itself."""
    rng = np.random.default_rng(11)
    rows = [np.concatenate([[i], rng.permutation(np.delete(np.arange(BINS), i))]) for i in range(BINS)]
    return np.array(rows, np.int64)


_PROBES = _probes()


def sketch(x: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a set (ascending hashes, not empty); an empty bin has that of the first filled one it looks at.

    Each hash falls into one bin, so a set is hashed once for all bins.  The
    looks depend on the bin alone: two sets agree in a bin with a probability
    equal to their similarity, whether it was filled or borrows.
    """
    low = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    at = (x % np.uint64(BINS)).astype(np.int64)
    low[at[::-1]] = x[::-1]  # the last write is the least
    filled[at] = True
    return low[_PROBES[np.arange(BINS), filled[_PROBES].argmax(axis=1)]]


def bands(x: np.ndarray) -> np.ndarray:
    """A bucket's key for each band; equal sets have equal keys."""
    key = np.arange(BANDS, dtype=np.uint64)
    for row in sketch(x).reshape(BANDS, ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            halves, sizes, keys = [], [], []
            for t in batch.column(3):
                x = shingles(t.as_py(), words)
                h = xxhash.xxh3_128_intdigest(x.tobytes())
                halves.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
                sizes.append(len(x))
                keys.append(bands(x) if len(x) else np.zeros(0, np.uint64))
            a, b = zip(*halves) if halves else ((), ())
            flat = pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sizes, pa.int64()), lists], names=["id", "x", "y", "a", "b", "n", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(1)]
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), flat)], names=["s", "set"])

    return run


def whole(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(s, set) of the distinct ``nodes`` (s), made anew from one of the ``texts`` (s, t) of each."""
    of = texts.join(small(nodes, BROADCAST_ROWS), "s", "left_semi").groupBy("s").agg(F.first("t").alias("t"))
    return written(of.mapInArrow(_sets(words), "s bigint, set array<bigint>"), "sets")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that reach the similarity to the hub whose row stands before theirs."""
    last: tuple | None = None
    hub = np.zeros(0, np.int64)
    for batch in batches:
        offsets, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
        u, v = [], []
        for k, (key, block, member, s) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            x = flat[offsets[k] : offsets[k + 1]]
            if not member:
                last, hub = (key, block), x
            elif last == (key, block):
                both = len(np.intersect1d(hub, x, assume_unique=True))
                if both * SIMILARITY[1] >= (len(hub) + len(x) - both) * SIMILARITY[0]:
                    u.append(key)
                    v.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def confirmed(stars: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The ``stars`` (u, v) whose member v reaches the similarity to the hub u by whole sets.

    A hub's members are dealt into blocks, each with one copy of the hub's set,
    which are then read in order: no task holds more than one hub and a batch.
    """
    sets = whole(stars.select(F.explode(F.array("u", "v")).alias("s")).distinct(), texts, words)
    sizes = stars.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = stars.join(sizes, "u").select("u", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("block"), F.lit(True).alias("member"), F.col("v").alias("s"))
    hubs = sizes.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("member"), F.col("u").alias("s"))
    rows = dealt.unionByName(hubs).join(sets, "s").select("u", "block", "member", "s", "set")
    ordered = rows.repartition(partitions(stars.sparkSession), "u", "block").sortWithinPartitions("u", "block", "member")
    return ordered.mapInArrow(_held, "u bigint, v bigint")


def links(sets: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, root) of those of the ``sets`` (s, n, bands) that chains of confirmed links connect.

    Each bucket gives a star: its least set and every other one, so a bucket
    has as many candidates as members.  Members may be alike without being like
    the hub; where a bucket's members are not all connected by the stars, those of
    different components are compared with each other, in blocks, once for
    all buckets of the same members.
    """
    fits = lambda a, b: F.least(a, b) * SIMILARITY[1] >= F.greatest(a, b) * SIMILARITY[0]
    entries = sets.select("s", "n", F.explode("bands").alias("key"))
    hubs = entries.groupBy("key").agg(F.min(F.struct("s", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    members = written(entries.join(hubs.select("key", "hub"), "key"), "buckets")
    stars = members.where((F.col("s") != F.col("hub.s")) & fits(F.col("n"), F.col("hub.n"))).select(F.col("hub.s").alias("u"), F.col("s").alias("v"))
    edges = written(confirmed(written(stars.distinct(), "stars"), texts, words), "links")
    roots = components(edges)
    rest = members.join(roots, members["s"] == roots["node"], "left").select("key", "s", F.coalesce("root", "s").alias("root"))
    rest = written(rest, "rooted")
    seen = rest.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("s")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "s")).alias("y"))
    open_ = seen.where("a <> b and m > 2").groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    rest = written(rest.join(small(written(open_, "open"), BROADCAST_ROWS), "key"), "apart")
    full = whole(rest.select("s").distinct(), texts, words)
    # Every two blocks of a bucket meet in a group of their own.
    mine, other = F.pmod(F.xxhash64("s"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = rest.select("key", "s", "root", mine.alias("mine"), other).select("key", "s", "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    more = dealt.join(full, "s").groupBy("key", "i", "j").applyInPandas(_compared, "u bigint, v bigint")
    return components(edges.unionByName(written(more.distinct(), "more")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n, least) of every row: the size of its set of shingles, and the smallest id that links reach, its own included.

    Sets are distinct shingles of ``words`` words, A-Z in lower case; a text of
    fewer words is one shingle.  Two rows are linked if their sets have a
    Jaccard similarity of 0.8 at least, so rows of equal sets are.  A text
    without words, a null or empty one, has no set and is linked with nothing:
    its least is its own id.  Rows that share an id, or repeat, are rows of
    their own.  Null ids are linked like others but are never the least unless
    only null ids are reached; then least is null.  Texts are read whole however
    long; other columns are not looked at, whatever they are called; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("x"), F.xxhash64(F.lit(1), text_col).alias("y"), F.col(text_col).cast("string").alias("t"))
    sketches = written(rows.mapInArrow(_sketches(words), "id bigint, x bigint, y bigint, a bigint, b bigint, n bigint, bands array<bigint>"), "sketches")
    # Equal sets are one node, told by 128 bits; its number is written with it, so that no later job sees another.
    distinct = sketches.where("n > 0").groupBy("a", "b").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("id").alias("least"), F.min(F.struct("x", "y")).alias("one"))
    sets = written(distinct.withColumn("s", F.monotonically_increasing_id()), "distinct")
    named = sets.select(F.col("one.x").alias("x"), F.col("one.y").alias("y"), "s")
    texts = rows.select("x", "y", "t").join(small(named, BROADCAST_ROWS), ["x", "y"]).select("s", "t")
    roots = links(sets.select("s", "n", "bands"), texts, words)
    grouped = sets.join(roots, sets["s"] == roots["node"], "left").select("a", "b", "least", F.coalesce("root", "s").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("least"))
    of = written(grouped.select("a", "b", "root").join(least, "root").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "least"), "least")
    found = sketches.select("id", "n", "a", "b").join(small(of, BROADCAST_ROWS), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    return found.select("id", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("least"))


def op11_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of 4-word shingles, the smallest id of its component, and whether it is that one; awkward rows as in ``near_duplicates``."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"))
