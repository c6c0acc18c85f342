"""Near copies by exact Jaccard similarity of word shingles: a tree over fingerprints and MinHash bands propose pairs, whole sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import short_batches, small, written
from .components import components
from .simhash import majority

#: Words of a shingle, and the similarity from which texts are near copies, as a fraction.
WORDS, SIMILARITY, SEED = 5, (4, 5), 42
#: Bands of so many minima each: a pair at similarity 0.8 is in no band in common with probability (1 - 0.8^4)^24 = 3e-6.
BANDS, ROWS = 24, 4
#: Shingles hashed at once, so that what is held stays in the processor's cache.
CHUNK = 512
#: Sets of a band that are compared at once, two blocks at a time, and shingles whose products are taken at once.
BLOCK, COLUMNS = 512, 4096
BROADCAST_ROWS = 1_500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FAMILY = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for i in range(min(len(h), words)):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def bands(x: np.ndarray) -> np.ndarray:
    """A key for each band of a set's minima; equal sets have equal keys."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for lo in range(0, len(x), CHUNK):
        np.minimum(low, (_FAMILY[0] * x[None, lo : lo + CHUNK] + _FAMILY[1]).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        sets, sizes, keys, prints = [], [], [], []
        for t in batch.column(2):
            x = shingles(t.as_py())
            sets.append(xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63))
            sizes.append(len(x))
            keys.append(bands(x))
            prints.append(majority(x))
        flat = pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(np.array(prints, np.uint64).view(np.int64))], names=["id", "x", "s", "n", "bands", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(1)]
        flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["s", "set"])


def whole(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(s, set) of the distinct ``nodes`` (s); ``texts`` (s, t): texts of each set, all of them the same."""
    of = texts.join(small(nodes, BROADCAST_ROWS), "s", "left_semi").groupBy("s").agg(F.first("t").alias("t"))
    return written(of.mapInArrow(_sets, "s bigint, set array<bigint>"), "sets")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) of sets whose similarity reaches the threshold."""
    sets = whole(pairs.select(F.explode(F.array("u", "v")).alias("s")).distinct(), texts)
    out = pairs.join(sets.withColumnsRenamed({"s": "u", "set": "a"}), "u").join(sets.withColumnsRenamed({"s": "v", "set": "b"}), "v")
    both = F.size(F.array_intersect("a", "b"))
    return out.where(both * SIMILARITY[1] >= (F.size("a") + F.size("b") - both) * SIMILARITY[0]).select("u", "v")


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs (u, v) of different roots whose similarity reaches the threshold, from the products of all sets of a block."""
    s, root, sets = rows["s"].to_numpy(), rows["root"].to_numpy(), rows["set"].tolist()
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of a single set is in no intersection.
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    good = both * SIMILARITY[1] >= (sizes[:, None] + sizes[None] - both) * SIMILARITY[0]
    i, j = np.nonzero(np.triu(good & (root[:, None] != root[None]), 1))
    return pd.DataFrame({"u": s[i], "v": s[j]})


def tree_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``sets`` (s, fp) that a vantage-point tree over their fingerprints proposes: sets of one fingerprint, and of linked ones."""
    least = written(sets.groupBy("fp").agg(F.min("s").alias("u"), F.count("*").alias("m")), "fingerprints")
    same = sets.join(least.where("m > 1"), "fp").where("s <> u").select("u", F.col("s").alias("v"))
    near = simhash.links(least.select("fp")).withColumnsRenamed({"u": "a", "v": "b"})
    of = lambda end, name: least.select(F.col("fp").alias(end), F.col("u").alias(name))
    return same.unionByName(near.join(of("a", "u"), "a").join(of("b", "v"), "b").select("u", "v"))


def links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the ``sets`` (s, n, bands, fp) that chains of verified pairs connect.

    The tree's pairs come first.  Fingerprints alone cannot be held to the
    similarity, so bands of minima propose the others.
    Each set is held against the least one of its band, which settles
    groups of close copies by as many pairs as they have members.  Where
    members of a band are not connected by that, all its pairs that lie in
    different components are verified, by blocks.  Pairs of the first step
    whose sizes rule out the similarity are left out.
    """
    entries = sets.select("s", "n", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("band", "key").agg(F.min(F.struct("s", "n")).alias("least"), F.count("*").alias("m")).where("m > 1")
    shared = written(entries.join(shared.select("band", "key", "least"), ["band", "key"]), "bands")
    fits = lambda a, b: F.least(a, b) * SIMILARITY[1] >= F.greatest(a, b) * SIMILARITY[0]
    stars = shared.where((F.col("s") != F.col("least.s")) & fits(F.col("n"), F.col("least.n"))).select(F.col("least.s").alias("u"), F.col("s").alias("v"))
    pairs = stars.unionByName(tree_pairs(sets.select("s", "fp")))
    stars = written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "stars")
    edges = written(verified(stars, texts), "links")
    roots = components(edges)
    rest = shared.join(roots, shared["s"] == roots["node"], "left").select("band", "key", "s", "n", F.coalesce("root", "s").alias("root"))
    rest = written(rest, "rooted")
    open_ = rest.groupBy("band", "key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("a <> b").select("band", "key", "blocks")
    rest = written(rest.join(open_, ["band", "key"]), "open")
    sets = whole(rest.select("s").distinct(), texts)
    # Every two blocks of a band meet in a group of their own.
    mine, other = F.pmod(F.xxhash64("s"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = rest.select("band", "key", "s", "root", mine.alias("mine"), other).select("band", "key", "s", "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    more = dealt.join(sets, "s").groupBy("band", "key", "i", "j").applyInPandas(_compared, "u bigint, v bigint")
    return components(edges.unionByName(written(more.distinct(), "more")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x, least) of every row: x is the hash of its text, least the (id, x) of its component that stays.

    Rows are linked if their shingle sets have a Jaccard similarity of
    SIMILARITY at least; least is the smallest (id, x) reached over links, ids
    before nulls.  Texts without words, null ones included, are copies of each
    other.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("t"))
    sketches = written(rows.mapInArrow(_sketches, "id bigint, x bigint, s bigint, n bigint, bands array<bigint>, fp bigint"), "sketches")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "x")
    sets = written(sketches.groupBy("s").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.min(key).alias("least"), F.min(F.struct(F.col("x"))).alias("one")), "distinct")
    # One text of each set, found by its hash.
    texts = rows.select("x", "t").join(small(sets.select(F.col("one.x").alias("x"), "s"), BROADCAST_ROWS), "x").select("s", "t")
    roots = links(sets.select("s", "n", "bands", "fp"), texts)
    grouped = sets.join(roots, sets["s"] == roots["node"], "left").select("s", "least", F.coalesce("root", "s").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("least"))
    of = written(grouped.select("s", "root").join(least, "root").select("s", "least"), "least")
    return sketches.select("id", "x", "s").join(of, "s").select("id", "x", F.col("least.id").alias("least_id"), F.col("least.x").alias("least_x"))
