"""Exact repeated substrings, from the sorted columns of aligned passages.

Sorting every suffix of a corpus by inserting one symbol of each document a
round takes as many passes over all the data as the longest document has bytes.
Here the rounds are bounded: every string of the wanted length holds one anchor
that its own bytes choose, so equal strings agree on it, and only passages
around a repeated anchor are sorted.  They stand aligned at the anchor; each
round inserts the symbol of one column, and updates the order of the suffixes
that begin there and the common prefixes of neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, small, table, written

LENGTH = 200
#: Bytes of an anchor; a string of LENGTH bytes has LENGTH - GRAM + 1 of them to choose from.
GRAM = 64
#: Bytes looked at together.
BUFFER = 1 << 19
#: Rows of a batch taken as Python objects at once.
ROWS = 256
#: Passages sorted together, about, and the most that share an anchor; beyond, their strings are counted by hash.
TOGETHER, MOST = 4096, 1 << 15
BROADCAST_ROWS = 1_500_000

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(buffer: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each position on, by doubling from 8 bytes."""
    n = len(buffer) - 7
    if n < GRAM - 7:
        return np.zeros(0, np.uint64)
    h = np.ndarray((n,), "<u8", buffer, 0, (1,)) * _C[0]
    h ^= h >> np.uint64(29)
    size = 8
    while size < GRAM:
        h = (h[:-size] * _C[1] + h[size:]) * _C[2]
        h ^= h >> np.uint64(32)
        size *= 2
    return h * _C[3]


def anchors(buffer: bytes, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position, first start and number of starts of each anchor of texts that end at ``ends``.

    The anchor of a string is its gram of smallest hash, the first if several
    are.  Starts of strings that have the same anchor are neighbours.
    """
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    h = gram_hashes(buffer)
    starts = len(buffer) - length + 1
    if starts <= 0:
        return none
    bits = np.uint64(24)
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    wide, span = length - GRAM + 1, 1
    low = key
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:starts], low[wide - span : wide - span + starts])
    at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    valid = np.zeros(len(buffer) + 1, bool)
    begin = 0
    for end in ends.tolist():
        if end - begin >= length:
            valid[begin : end - length + 1] = True
        begin = end
    good = np.flatnonzero(valid[:starts])
    if not len(good):
        return none
    at = at[good]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(good, prepend=-2) != 1))
    return h[at[new]], at[new], good[new], np.diff(np.append(new, len(good)))


def _buffers(batch: pa.RecordBatch) -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """Texts of a batch, the distinct ones once, as bytes joined to about BUFFER: rows, bytes, ends."""
    rows, parts, size, seen = [], [], 0, set()
    keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    for i, t in enumerate(batch.column(2)):
        if keys[i] in seen:
            continue
        seen.add(keys[i])
        b = t.as_py() or b""
        if len(b) >= LENGTH:
            rows.append(i)
            parts.append(b)
            size += len(b)
        if size >= BUFFER or i == batch.num_rows - 1:
            if size >= 1 << 24:  # texts that long go one by one
                for r, p in zip(rows, parts):
                    yield [r], p, np.array([len(p)])
            elif rows:
                yield rows, b"".join(parts), np.cumsum([len(p) for p in parts])
            rows, parts, size = [], [], 0
    if rows:
        yield rows, b"".join(parts), np.cumsum([len(p) for p in parts])


def _long_anchors(buffer: bytes, ends: np.ndarray):
    """``anchors`` in parts of 2^23 bytes where the buffer is longer than its positions have bits for."""
    part = 1 << 23
    if len(buffer) < 1 << 24:
        yield 0, anchors(buffer, ends)
        return
    for lo in range(0, len(buffer) - LENGTH + 1, part):  # one text
        piece = buffer[lo : lo + part + LENGTH - 1]
        yield lo, anchors(piece, np.array([len(piece)]))


def _anchor_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, buffer, ends in _buffers(batch):
            for _, (h, *_) in _long_anchors(buffer, ends):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, x, c, s, n, l, g): anchor, text, first start, number of starts, bytes before the anchor, hash of the passage."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        xs, cs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for rows, buffer, ends in _buffers(batch):
            begins = np.concatenate([[0], ends[:-1]])
            for lo, (h, at, s, n) in _long_anchors(buffer, ends):
                text = np.searchsorted(ends, s, "right") if lo == 0 else np.zeros(len(s), int)
                before = at - s
                g = np.array([digest(buffer[a:b], k) for a, b, k in zip((s + lo).tolist(), (s + lo + n + LENGTH - 1).tolist(), before.tolist())], np.uint64)
                row = np.array(rows)[text] if len(text) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(xs[row]), pa.array(cs[row]), pa.array(s + lo - begins[text]), pa.array(n.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(g.view(np.int64))], names=["h", "x", "c", "s", "n", "l", "g"]
                )


def repeated_starts(group: np.ndarray, before: np.ndarray, starts: np.ndarray, passages: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For each passage and start, whether the string of ``length`` bytes there is in another passage of its group, at the same distance from the anchor.

    Columns are taken from the last to the first.  A round puts one symbol of
    each passage before its suffix: these symbols, in the order so far, are the
    round's column of the passages' Burrows-Wheeler transform.  The new order is that of symbols, stable in
    the order so far, and two neighbours' common prefix is one more than the
    least between their old places, or nothing if their symbols differ.
    """
    m, left = len(passages), int(before.max())
    width = left + max(len(p) - int(b) for p, b in zip(passages, before))
    symbols = np.full((width, m), -1, np.int32)  # a column is a row here
    for i, (p, b) in enumerate(zip(passages, before.tolist())):
        symbols[left - b : left - b + len(p), i] = np.frombuffer(p, np.uint8)
    found = np.zeros((m, left + 1 + LENGTH), bool)
    order = np.argsort(group, kind="stable")
    prefix = np.zeros(m + 1, np.int32)
    first = left - before
    base = group.astype(np.int64) * 257 + 1
    for j in range(width - 1, -1, -1):
        s = symbols[j, order]  # the transform's column
        key = base[order] + s
        step = np.argsort(key, kind="stable")
        order, key, s = order[step], key[step], s[step]
        same = np.flatnonzero((key[1:] == key[:-1]) & (s[1:] >= 0)) + 1
        new = np.zeros(m + 1, np.int32)
        if len(same):
            bounds = np.stack([step[same - 1] + 1, step[same] + 1], 1).ravel()
            new[same] = 1 + np.minimum.reduceat(prefix, bounds)[::2]
        prefix = new
        there = np.flatnonzero((prefix[:-1] >= length) | (prefix[1:] >= length))
        if len(there):
            who = order[there]
            offset = j - first[who]
            ok = (offset >= 0) & (offset < starts[who])
            found[who[ok], offset[ok]] = True
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    passages = rows["bytes"].tolist()
    _, group = np.unique(rows["h"].to_numpy(), return_inverse=True)
    found = repeated_starts(group, rows["l"].to_numpy(), rows["n"].to_numpy(), passages)
    runs = [[{"a": a, "b": b} for a, b in _runs(f)] for f in found]
    keep = [i for i, r in enumerate(runs) if r]
    return pd.DataFrame({"h": rows["h"].to_numpy()[keep], "g": rows["g"].to_numpy()[keep], "runs": [runs[i] for i in keep]})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the passages wanted of each text."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            texts, lists = batch.column(0).slice(lo, ROWS), batch.column(1).slice(lo, ROWS)
            flat = lists.flatten()  # arrays, as Python objects for every passage would take much more room
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            s, n = flat.field("s").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
            data, row, text = [], -1, b""
            for i, a, b in zip(of.tolist(), s.tolist(), (s + n + LENGTH - 1).tolist()):
                if i != row:
                    row, text = i, texts[i].as_py()
                data.append(text[a:b])
            yield pa.RecordBatch.from_arrays([*(flat.field(k) for k in ("h", "g", "l", "n", "k")), pa.array(data, pa.binary())], names=["h", "g", "l", "n", "k", "bytes"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of a passage by two hashes, for anchors too common to sort around."""
    import xxhash

    for batch in batches:
        for row in batch.to_pylist():
            n, data = row["n"], row["bytes"]
            d = [xxhash.xxh128_digest(data[i : i + LENGTH], row["l"] - i & 0xFFFF) for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([row["h"]] * n, pa.int64()), pa.array([row["g"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(d, pa.binary())], names=["h", "g", "i", "digest"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(x, c, spans): byte spans of the texts (x, c, text) to remove; (x, c) are hashes that tell texts apart.

    ``texts`` may have a text several times; a text that does is removed as a
    whole by the caller.
    """
    short_batches(texts.sparkSession)
    counts = texts.mapInArrow(_anchor_hashes, "h bigint").groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    alive = small(written(counts, "anchors"), BROADCAST_ROWS)
    places = texts.mapInArrow(_passages, "h bigint, x bigint, c bigint, s bigint, n int, l int, g bigint")
    places = written(places.join(alive, "h").distinct(), "places")
    kinds = written(places.groupBy("h", "g").agg(F.count("*").alias("m"), F.min(F.struct("x", "c", "s", "n", "l")).alias("r")), "kinds")
    mixed = kinds.groupBy("h").agg(F.count("*").alias("k"), F.min("m").alias("least")).where("k > 1 and least = 1").select("h", "k")
    asked = kinds.join(mixed, "h").select("h", "g", "k", "r.*")
    wanted = asked.groupBy("x", "c").agg(F.collect_list(F.struct("h", "g", "s", "n", "l", "k")).alias("wanted"))
    once = texts.join(wanted, ["x", "c"]).dropDuplicates(["x", "c"]).select("text", "wanted")
    cut = written(once.mapInArrow(_cut, "h bigint, g bigint, l int, n int, k bigint, bytes binary"), "passages")
    number = max(1, cut.count() // TOGETHER)
    less = cut.where(F.col("k") <= MOST)
    runs = less.groupBy(F.pmod(F.xxhash64("h"), F.lit(number)).alias("b")).applyInPandas(_sorted, "h bigint, g bigint, runs array<struct<a:int,b:int>>")
    more = cut.where(F.col("k") > MOST).select("h", "g", "l", "n", "bytes")
    if more.limit(1).count():
        strings = more.mapInArrow(_strings, "h bigint, g bigint, i int, digest binary")
        twice = strings.groupBy("h", "digest").agg(F.count("*").alias("m")).where("m > 1").select("h", "digest")
        single = strings.join(twice, ["h", "digest"]).groupBy("h", "g").agg(F.transform(F.collect_list("i"), lambda i: F.struct(i.alias("a"), i.alias("b"))).alias("runs"))
        runs = runs.unionByName(single)
    # Written, so that Spark sees two plain sides and can split the places of a passage that is everywhere.
    verdicts = written(kinds.select("h", "g", "m").join(runs, ["h", "g"], "left").where("m > 1 or runs is not null"), "verdicts")
    marked = places.join(verdicts, ["h", "g"])
    starts = F.when(F.col("m") > 1, F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b")))).otherwise(F.col("runs"))
    spans = F.transform(starts, lambda r: F.struct((F.col("s") + r["a"]).alias("lo"), (F.col("s") + r["b"] + LENGTH).alias("hi")))
    return marked.select("x", "c", F.explode(spans).alias("span")).groupBy("x", "c").agg(F.collect_list("span").alias("spans"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.select(["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) for b in _removed(batches))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            out = []
            for text, copied, spans in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                b = text.as_py() or b""
                if copied and len(b) >= LENGTH:
                    merged = [[0, len(b)]]
                else:
                    merged = []
                    inner = spans.values
                    pairs = [] if inner is None else zip(inner.field("lo").to_pylist(), inner.field("hi").to_pylist())
                    for lo, hi in sorted(pairs):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], hi)
                        else:
                            merged.append([lo, hi])
                at, kept = 0, []
                for lo, hi in merged:
                    kept.append(b[at:lo])
                    at = hi
                kept = b"".join([*kept, b[at:]])
                out.append((len(b), len(b) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Removes every byte of a string of LENGTH bytes that also starts anywhere else; one row per row of ``docs``.

    Texts are UTF-8 bytes, a null text is empty; strings do not cross texts.
    Of repeated rows and copies nothing is left if they have LENGTH bytes.  All
    strings are judged on the input, whole texts however long they are; other
    columns are not looked at, whatever they are called; an empty table gives no
    rows.  Returns (id, n_bytes, n_removed, n_spans,
    kept_sha256, kept), where ``kept`` has the bytes that stay; it is left out if not ``keep``.
    """
    b = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(b).alias("x"), (F.crc32(b) + F.length(b) * (1 << 32)).alias("c"), b.alias("text"))
    spans = repeated_spans(rows.select("x", "c", "text"))
    copies = rows.groupBy("x", "c").agg(F.count("*").alias("m")).where("m > 1").select("x", "c", F.lit(True).alias("copied"))
    # One written table, so that Spark can split the rows of a text that is everywhere.
    marks = written(copies.join(spans, ["x", "c"], "full_outer"), "marks")
    out = rows.join(marks, ["x", "c"], "left").select("id", "text", F.coalesce("copied", F.lit(False)), "spans")
    shape = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    out = out.mapInArrow(_removed, f"{shape}, kept binary") if keep else out.mapInArrow(_digested, shape)
    return out.withColumnRenamed("id", id_col)


def op3_column_sorted_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes, removed runs and a checksum of what is left of every document; awkward rows as in ``remove_repeats``."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep=False)
