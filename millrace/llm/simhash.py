"""SimHash near-duplicates by vantage-point trees over fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table, written
from .components import components

WORDS, RADIUS, SEED = 3, 2, 42
BITS = 64
#: Fingerprints among which vantage points are chosen.
SAMPLE = 256
#: Levels of the tree that deal fingerprints into shards, by their number.  The fullest shard has 2, 0.5, 0.15, 0.02 or
#: 0.003 % of random ones, so that it stays in the tens of thousands, and each is sent to 7, 13, 21, 43 or 73 shards.
LEVELS = ((1 << 19, 2), (1 << 22, 3), (1 << 25, 4), (1 << 28, 6), (1 << 63, 8))
#: Levels below, within a shard.
INNER = 4


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a whole text; zero if it has no words."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = (ends - np.fromiter(map(len, w), np.int64, len(w)) - 1).tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    return majority(np.array(hashes, "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp) of every row; fp holds the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id bigint, fp bigint")


@cache
def steps(levels: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of distances to ``levels`` vantage points that fingerprints within ``radius`` may have."""
    return [s for s in product(range(-radius, radius + 1), repeat=levels) if sum(map(abs, s)) <= radius]


def _masks(levels: int) -> list[int]:
    width = BITS // levels
    return [((1 << width) - 1) << (i * width) for i in range(levels)]


def vantage_points(sample: np.ndarray, levels: int) -> list[int]:
    """For each level the sampled fingerprint from which the others' distances differ most."""
    points = []
    for mask in _masks(levels):
        part = sample & np.uint64(mask)
        spread = np.bitwise_count(part[:, None] ^ part[None]).astype(float).var(axis=1)
        points.append(int(sample[int(spread.argmax())]))
    return points


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distances(fp: Column, points: list[int]) -> list[Column]:
    """Hamming distance to the vantage point of each level, over the level's own bits."""
    return [F.bit_count((fp.bitwiseAND(F.lit(_signed(m)))).bitwiseXOR(F.lit(_signed(p & m)))) for p, m in zip(points, _masks(len(points)))]


def near_pairs(home: np.ndarray, probes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (of ``home``, of ``home`` or ``probes``) within ``radius`` bits, by a tree of INNER levels.

    Fingerprints are put under the distances of their slices to those of a
    vantage point.  As slices are disjoint, what one level's distances differ by
    is no longer left for the others, and a branch is pruned when the
    differences add up to more than the radius.
    """
    points = vantage_points(home[np.linspace(0, len(home) - 1, min(len(home), 64)).astype(int)], INNER)
    base = BITS // INNER + 2 * radius + 1

    def code(fps: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fps), np.int64)
        for p, m in zip(points, _masks(INNER)):
            out = out * base + np.bitwise_count((fps ^ np.uint64(p)) & np.uint64(m)) + radius
        return out

    order = np.argsort(code(home), kind="stable")
    home = home[order]
    leaves = code(home)
    asked = np.concatenate([home, probes])
    at = code(asked)
    left, right = [], []
    for step in steps(INNER, radius):
        shift = 0
        for s in step:
            shift = shift * base + s
        lo, hi = np.searchsorted(leaves, at + shift), np.searchsorted(leaves, at + shift, "right")
        # In parts, so that what is compared at once stays bounded.
        there = np.flatnonzero(hi > lo)
        ends = np.cumsum((hi - lo)[there])
        part = 0
        while part < len(there):
            upto = max(part + 1, int(np.searchsorted(ends, (ends[part - 1] if part else 0) + (1 << 21))))
            rows = there[part:upto]
            count = (hi - lo)[rows]
            who = np.repeat(rows, count)
            whom = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[rows], count)
            good = np.bitwise_count(asked[who] ^ home[whom]) <= radius
            good &= asked[who] != home[whom]
            left.append(asked[who[good]])
            right.append(home[whom[good]])
            part = upto
    return (np.concatenate(left), np.concatenate(right)) if left else (home[:0], home[:0])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs (a, b) connect: each node to the least it is connected to."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct ``fps`` (fp) that chains of pairs within ``radius`` connect.

    The top of the tree deals fingerprints into shards by their distances to
    vantage points.  A fingerprint whose ball of the radius reaches over a
    boundary is also sent to the shard beyond, if that comes later in order, so
    that every pair meets in one shard.
    """
    spark = fps.sparkSession
    count = fps.count()
    sample = [r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    if count < 2:
        return spark.createDataFrame([], "u bigint, v bigint")
    levels = next(n for most, n in LEVELS if count <= most)
    points = vantage_points(np.array(sample, np.int64).view(np.uint64), levels)
    zero = (0,) * levels
    reach = [s for s in steps(levels, radius) if s >= zero]
    width = BITS // levels
    at = distances(F.col("fp"), points)
    shards = F.filter(F.array(*[F.struct(F.lit(s == zero).alias("home"), F.array(*[(d + x).cast("int") for d, x in zip(at, s)]).alias("shard")) for s in reach]), lambda c: F.forall(c["shard"], lambda d: (d >= 0) & (d <= width)))
    dealt = fps.select("fp", F.explode(shards).alias("c")).select("fp", "c.home", "c.shard")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        own = rows["home"].to_numpy(bool)
        u, v = near_pairs(fp[own], fp[~own], radius) if own.any() else (fp[:0], fp[:0])
        u, v = _forest(u, v) if len(u) else (u, v)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return dealt.groupBy("shard").applyInPandas(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Rows are linked if their fingerprints differ in ``radius`` bits at most;
    a row's component is the smallest id it reaches over links, its own
    included.  A null or empty text, or one without words, has fingerprint zero.
    Texts of fewer words than a shingle are one shingle, whole texts are read
    however long.  Repeated rows get one row each; a null id is smaller than none
    and counts where nothing else is reached; other columns are not looked at,
    whatever they are called; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    distinct = written(distinct, "distinct")
    roots = components(links(distinct.select("fp"), radius))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of = grouped.join(least, "root").select("fp", "component_id")
    out = prints.join(of, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; awkward rows as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
