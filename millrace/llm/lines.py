"""Line dedup: exact copies, and a segment-partition join of lines a few edits apart."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, small, table, written


class Rule(NamedTuple):
    """Which lines are near: up to ``most`` edits, of which the shorter line allows one for every ``chars`` characters.

    Lines shorter than ``least`` go only as exact copies: too many differ in a
    letter and say something else.
    """

    most: int = 2
    chars: int = 20
    least: int = 20

    def edits(self, length: int) -> int:
        """Edits up to which a line of ``length`` and one that is no shorter are near; it is split into one segment more."""
        return min(self.most, length // self.chars) if length >= self.least else 0


RULE = Rule()
#: Groups of lines with segments in common are compared pair by pair up to this size, and split further beyond; rows compared in one call, about.
PAIRWISE, TOGETHER = 64, 4096
#: Groups up to this size are split within a task, larger ones by a round of jobs.
INSIDE = 1024
BROADCAST_ROWS = 500_000
#: Keys, of 8 bytes each, up to which every worker holds those that are shared.
SHARED_KEYS = 4_000_000

#: Roles of a line in a group: as the shorter of a pair, or of two of one length the one that stays in place; as the other; as either.
SHORTER, LONGER, SAME = 0, 1, 2


@lru_cache(1 << 14)
def segments(length: int, most: int) -> list[tuple[int, int]]:
    """First character and length of each of the ``most`` + 1 segments; the last ones are longer."""
    short, more = divmod(length, most + 1)
    sizes = [short + (i > most - more) for i in range(most + 1)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


@lru_cache(1 << 14)
def shifts(i: int, most: int, longer: int) -> range:
    """How far segment ``i`` may have moved in a line ``longer`` characters longer.

    Of the segments that two near lines have in common, one has at most ``i``
    edits before it and ``most - i`` behind it, and moves by no more than these.
    """
    return range(max(-i, longer - (most - i)), min(i, longer + (most - i)) + 1)


def split_lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def line_hash(line: str) -> tuple[int, int]:
    """128 bits as two signed numbers."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of ``a`` and ``b`` is at most ``most``: bit vectors over the band of 2 * ``most`` + 1 diagonals.

    Common ends are cut off first.  Bit t of a vector is row j - most + t of
    column j, so that from column to column the vectors move down by a row.
    """
    if abs(len(a) - len(b)) > most:
        return False
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    m = len(a)
    if not a or not b or most < 2:  # one edit is all that is left, if these are one
        return max(m, len(b)) <= most
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    width = 2 * most + 1
    mask, last = (1 << width) - 1, 1 << width - 1
    vp, vn, score = (1 << width) - (1 << most), 0, min(most, m)
    for j, c in enumerate(b, 1):
        at = j - most - 1
        eq = (peq.get(c, 0) >> at if at >= 0 else peq.get(c, 0) << -at) & mask
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        if j <= m - most:  # along the lowest diagonal
            score += not d0 & last
            if score > most + most - m + len(b):  # the last row is so far along the other diagonal
                return False
        else:  # along the last row
            row = 1 << m - j + most
            score += bool(hp & row) - bool(hn & row)
        vp, vn = (hn | ~(d0 >> 1 | hp)) & mask, d0 >> 1 & hp
    return score <= most


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, at, hashes = [], [], []
        for k, t in enumerate(batch.column(3)):
            for i, line in enumerate(split_lines(t.as_py())):
                line = line.strip()
                if line:
                    of.append(k)
                    at.append(i)
                    hashes.append(line_hash(line))
        h, g = zip(*hashes) if hashes else ((), ())
        rows = pa.array(of, pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(3)), pa.array(at, pa.int32()), pa.array(h, pa.int64()), pa.array(g, pa.int64())], names=["d", "x", "y", "i", "h", "g"])


def _distinct_lines(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, tuple[int, int]]]:
    for batch in batches:
        found: dict[str, tuple[int, int]] = {}
        for t in batch.column(0):
            for line in split_lines(t.as_py()):
                line = line.strip()
                if len(line) >= rule.least and line not in found:
                    found[line] = line_hash(line)
        yield found


def _line_texts(rule: Rule, asked: np.ndarray | None = None):
    """(h, g, line) of the lines, only those whose h is ``asked`` for if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _distinct_lines(rule, batches):
            if asked is not None:
                there = np.isin(np.array([x[0] for x in found.values()], np.int64), asked)
                found = {line: x for (line, x), y in zip(found.items(), there.tolist()) if y}
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in found.values()], pa.int64()) for k in (0, 1)), pa.array(found.keys(), pa.string())], names=["h", "g", "line"])

    return run


@lru_cache(1 << 14)
def looks(rule: Rule, length: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(first character, last, seed of a hash, part) of all segments a line is found by and looks for, its own first; and how many are its own.

    A part tells how much shorter the line looked for is, the segment's number,
    and how far it has moved.
    """
    out = []
    for longer in range(rule.most + 1):
        shorter = length - longer
        most = rule.edits(shorter)
        if not most or longer > most:
            continue
        for i, (p, n) in enumerate(segments(shorter, most)):
            for s in shifts(i, most, longer):
                if (longer or s) and 0 <= p + s <= length - n:
                    out.append((p + s, p + s + n, shorter << 8 | i, part_of(longer, i, s)))
    own = [(p, p + n, length << 8 | i, part_of(0, i, 0)) for i, (p, n) in enumerate(segments(length, rule.edits(length))) if rule.edits(length)]
    return own + out, len(own)


def part_of(longer: int, i: int, shift: int) -> int:
    return (longer << 8 | i) << 8 | shift + 128


def _line_keys(rule: Rule):
    """(h, g, n, keys): hash and length of the lines, and the keys of all that ``looks`` says, of 8 bytes each, one after another."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for found in _distinct_lines(rule, batches):
            keys: list[int] = []
            sizes = [0]
            for line in found:
                asked, _ = looks(rule, len(line))
                data = line.encode("utf-8", "surrogatepass")
                if len(data) == len(line):
                    keys += [digest(data[a:b], seed) for a, b, seed, _ in asked]
                else:
                    keys += [digest(line[a:b].encode("utf-8", "surrogatepass"), seed) for a, b, seed, _ in asked]
                sizes.append(8 * len(asked))
            ends = np.cumsum(sizes, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(np.array(keys, np.uint64))])
            hashes = np.array(list(found.values()), np.int64).reshape(-1, 2)
            cols = [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(list(map(len, found)), pa.int32()), packed]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "g", "n", "keys"])

    return run


@lru_cache(1 << 14)
def _parts_of(rule: Rule, length: int) -> np.ndarray:
    return np.array([p for *_, p in looks(rule, length)[0]], np.int32)


def _keys(rule: Rule, shared: np.ndarray | None = None, whole: bool = False):
    """Keys (key, h, part) of lines as ``_line_keys`` gives them, with the second half g of their hashes if ``whole``, and only ``shared`` ones if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, g, n = (batch.column(c).to_numpy() for c in range(3))
            _, ends, data = batch.column(3).buffers()
            ends = np.frombuffer(ends, np.int32)[batch.column(3).offset :][: len(h) + 1]
            key = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].view(np.int64)
            of = np.repeat(np.arange(len(h)), np.diff(ends) // 8)
            part = np.concatenate([_parts_of(rule, x) for x in n.tolist()])
            if shared is not None:
                at = np.minimum(np.searchsorted(shared, key), max(0, len(shared) - 1))
                there = shared[at] == key if len(shared) else np.zeros(len(key), bool)
                key, of, part = key[there], of[there], part[there]
            cols = [pa.array(key), pa.array(h[of]), *([pa.array(g[of])] if whole else []), pa.array(part)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "h", *(["g"] if whole else []), "part"])

    return run


Piece = tuple[str, int, int]  # what is left of a line on one side, edits it may have, and how much longer the other line's is
STATE = "key bigint, h bigint, g bigint, d bigint, x bigint, i int, role int, pieces array<struct<t:string,e:int,s:int>>, way int"


def _next(key: int, *what: int | str) -> int:
    import xxhash

    x = xxhash.xxh64(seed=key & (1 << 64) - 1)
    for w in what:
        x.update(str(w).encode("utf-8", "surrogatepass") + b"\0")
    return x.intdigest() - (1 << 63)


def _folded(key: int, pieces: list[Piece]) -> tuple[int, list[Piece]] | None:
    """Pieces that may have no edits are the same in all lines of a group, so they go into its key; None where they cannot be."""
    left = []
    for t, e, s in pieces:
        if e:
            left.append((t, e, s))
        elif s:
            return None
        else:
            key = _next(key, t)
    return key, left


def _cut(piece: Piece, i: int, p: int, n: int, shift: int, role: int) -> tuple[str, list[Piece]]:
    """The segment of a piece and what is left beside it."""
    t, e, s = piece
    at = p + shift if role == LONGER else p
    return t[at : at + n], [(t[:at], i, shift), (t[at + n :], e - i, s - shift)]


def opened(rule: Rule, key: int, part: int, line: str) -> Iterator[tuple[int, int, list[Piece]]]:
    """Groups (key, role, pieces) of a line that was found under ``key`` by ``part``: one for each length and move of the lines it may be near to."""
    longer, i, shift = part >> 16, part >> 8 & 255, (part & 255) - 128
    if longer or shift:
        most = rule.edits(len(line) - longer)
        asked = [(longer, shift, LONGER)]
    else:
        most = rule.edits(len(line))
        asked = [(x, s, SHORTER if x or s else SAME) for x in range(most + 1) for s in shifts(i, most, x)]
    for x, s, role in asked:
        p, n = segments(len(line) - (x if role == LONGER else 0), most)[i]
        _, pieces = _cut((line, most, x), i, p, n, s, role)
        if (found := _folded(_next(key, x, s), pieces)) is not None:
            yield found[0], role, found[1]


def shorter_of(piece: Piece, role: int) -> int:
    return len(piece[0]) - (piece[2] if role == LONGER else 0)


def settled(pieces: list[Piece], role: int) -> bool:
    """Whether lines of a group are near whatever their pieces are."""
    return all(max(shorter_of(p, role), shorter_of(p, role) + p[2]) <= p[1] for p in pieces)


def divided(key: int, role: int, pieces: list[Piece]) -> list[tuple[int, int, list[Piece]]] | None:
    """The groups that a line's longest piece puts it into by one more segment; None if the pieces are too short for that."""
    size = [shorter_of(p, role) for p in pieces]
    k = max(range(len(pieces)), key=lambda k: (size[k] > pieces[k][1], size[k], -k))
    t, e, s = pieces[k]
    if size[k] <= e:
        return None
    out = []
    for i, (p, n) in enumerate(segments(size[k], e)):
        for shift in shifts(i, e, s):
            if not 0 <= p + shift <= size[k] + s - n:
                continue
            for own in (SHORTER, LONGER) if role == SAME and shift else (role,):
                same, left = _cut((t, e, s), i, p, n, shift, own)
                found = _folded(_next(key, i, shift, same), [*pieces[:k], *left, *pieces[k + 1 :]])
                if found is not None:
                    out.append((found[0], own, found[1]))
    return out


def _way(role: int, pieces: list[Piece]) -> int:
    """1 where a group's lines are all near, 2 where they must be compared as they are, else 0."""
    return 1 if settled(pieces, role) else 0 if any(shorter_of(p, role) > p[1] for p in pieces) else 2


def _state(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of lines in groups; made and told their ``way`` in one pass, as each further one takes another Python worker of every task."""
    cols = list(zip(*((*r[:7], _named(r[7]), _way(r[6], r[7])) for r in rows))) if rows else [()] * 9
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.list_(pa.struct([("t", pa.string()), ("e", pa.int32()), ("s", pa.int32())])), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "h", "g", "d", "x", "i", "role", "pieces", "way"])


def _named(pieces: list[Piece]) -> list[dict]:
    return [{"t": t, "e": e, "s": s} for t, e, s in pieces]


def _opened(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _state([(key, h, g, d, x, i, role, pieces) for at, h, g, d, x, i, part, line in zip(*(c.to_pylist() for c in batch.columns)) for key, role, pieces in opened(rule, at, part, line)])

    return run


def _divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for at, h, g, d, x, i, role, pieces in zip(*(c.to_pylist() for c in batch.columns)):
            for key, own, left in divided(at, role, [(p["t"], p["e"], p["s"]) for p in pieces]) or []:
                rows.append((key, h, g, d, x, i, own, left))
        yield _state(rows)


Member = tuple[tuple[int, int, int, int, int], int, list[Piece]]  # a line's (d, x, i, h, g), and its role and pieces


def _search(key: int, members: list[Member], late: set[tuple[int, int]], pairwise: int) -> None:
    """Adds to ``late`` the lines (h, g) of a group that have an earlier one whose pieces are all near; a group of more than ``pairwise`` is divided first."""
    groups = [(key, members)]
    while groups:
        key, members = groups.pop()
        members.sort(key=lambda m: m[0])
        roles = {role for _, role, _ in members}
        # Only lines behind the first one can be late, and those that are need no further look.
        if all(o[3:] in late or o[3:] == members[0][0][3:] for o, *_ in members) or len(roles) == 1 and SAME not in roles:
            continue
        way = _way(*members[0][1:])
        if way == 1:
            least: dict[int, tuple] = {}
            for o, role, _ in members:
                least.setdefault(role, o)
            for o, role, _ in members:
                other = least.get(role if role == SAME else LONGER if role == SHORTER else SHORTER)
                if other is not None and other < o and other[3:] != o[3:]:
                    late.add(o[3:])
        elif way == 2 or len(members) <= pairwise:
            for k, (o, role, pieces) in enumerate(members):
                if o[3:] not in late and any(o2[3:] != o[3:] and (role == role2 == SAME or role != role2) and all(within(p[0], q[0], p[1]) for p, q in zip(pieces, pieces2)) for o2, role2, pieces2 in members[:k]):
                    late.add(o[3:])
        else:
            parts: dict[int, list[Member]] = {}
            for o, role, pieces in members:
                for at, own, left in divided(key, role, pieces) or []:
                    parts.setdefault(at, []).append((o, own, left))
            groups += [(at, held) for at, held in parts.items() if len(held) > 1]


def _compared(pairwise: int):
    """Lines that have an earlier one in their group whose pieces are all near."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        groups: dict[int, list[Member]] = {}
        for key, *o, role, pieces in zip(*(rows[c].tolist() for c in ("key", "d", "x", "i", "h", "g", "role", "pieces"))):
            groups.setdefault(key, []).append((tuple(o), role, [(p["t"], p["e"], p["s"]) for p in pieces]))
        late: set[tuple[int, int]] = set()
        for key, members in groups.items():
            _search(key, members, late, pairwise)
        return pd.DataFrame(list(late), columns=["h", "g"]).astype("int64")

    return run


def near_lines(docs: DataFrame, first: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(h, g) of the lines that have an earlier line within the threshold; ``first`` (h, g, d, x, i): where each line is first.

    Two near lines have one of the shorter's segments in common, at most as far
    from its place as the edits beside it allow; lines are grouped by these.  A
    line in no group with another is done.  Groups of a few lines are compared:
    what is left on each side of the segment must be within the edits left for
    it.  In larger groups what is left is split into segments again, and the
    group divides by the next one in common, until it is small, or nothing is
    left to differ in: within one task as soon as it has ``INSIDE`` lines at
    most, as every further round costs jobs over all groups.
    """
    spark = docs.sparkSession
    hashed = written(docs.mapInArrow(_line_keys(rule), "h bigint, g bigint, n int, keys binary"), "keys")
    keys = hashed.mapInArrow(_keys(rule), "key bigint, h bigint, part int")
    own = F.col("part").bitwiseAND(0xFF00FF) == 128
    kinds = keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max(own.cast("int")).alias("own"))
    shared = written(kinds.where("a <> b and own = 1").select("key"), "shared")
    if shared.count() <= SHARED_KEYS:
        held = np.sort(shared.toArrow().column(0).to_numpy()) if shared.limit(1).count() else np.zeros(0, np.int64)
        box = spark.sparkContext.broadcast(held)
        parts = hashed.mapInArrow(lambda batches: _keys(rule, box.value, True)(batches), "key bigint, h bigint, g bigint, part int")
    else:
        parts = hashed.mapInArrow(_keys(rule, whole=True), "key bigint, h bigint, g bigint, part int").join(shared, "key")
    parts = written(parts.distinct(), "parts")
    lines = written(parts.select("h", "g").distinct(), "lines")
    asked = None
    if lines.count() <= BROADCAST_ROWS:
        asked = spark.sparkContext.broadcast(lines.select("h").toArrow().column(0).to_numpy() if lines.limit(1).count() else np.zeros(0, np.int64))
        lines = F.broadcast(lines)
    texts = docs.mapInArrow(lambda batches: _line_texts(rule, asked and asked.value)(batches), "h bigint, g bigint, line string").join(lines, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.first("line").alias("line"))
    state = parts.join(texts, ["h", "g"]).join(first, ["h", "g"]).select("key", "h", "g", "d", "x", "i", "part", "line").mapInArrow(_opened(rule), STATE)
    found = []
    for _ in range(60):
        state = written(state, "state")
        o = F.struct("d", "x", "i", "h", "g")
        sizes = state.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("h", "g")).alias("a"), F.max(F.struct("h", "g")).alias("b"), F.min("role").alias("r"), F.max("role").alias("s"), F.min(F.when(F.col("role") != LONGER, o)).alias("short"), F.min(F.when(F.col("role") != SHORTER, o)).alias("long"))
        pairs = F.col("a") != F.col("b")
        pairs &= ((F.col("r") == SAME) & (F.col("s") == SAME)) | ((F.col("r") == SHORTER) & (F.col("s") == LONGER))
        state = written(state.join(sizes.where(pairs).select("key", "n", "short", "long"), "key"), "groups")
        late = F.when(F.col("role") == SHORTER, F.col("long")).otherwise(F.col("short")) < o
        found.append(state.where(F.col("way") == 1).where(late).select("h", "g"))
        little = state.where((F.col("way") == 2) | ((F.col("way") == 0) & (F.col("n") <= INSIDE)))
        number = max(1, little.count() // TOGETHER)
        # A group that is to be split goes by itself, as it is more work than its rows tell.
        together = F.when((F.col("way") == 0) & (F.col("n") > PAIRWISE), F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(number)))
        found.append(little.select("key", "h", "g", "d", "x", "i", "role", "pieces", together.alias("b")).groupBy("b").applyInPandas(_compared(PAIRWISE), "h bigint, g bigint"))
        more = state.where((F.col("way") == 0) & (F.col("n") > INSIDE)).select("key", "h", "g", "d", "x", "i", "role", "pieces")
        if more.isEmpty():
            break
        state = more.mapInArrow(_divided, STATE)
    else:
        raise RuntimeError("groups of lines did not come to an end")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _row_key(id_col: str, text_col: str) -> list:
    """(d, x, y) of a row: its id, and its text by 128 bits."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text_col).alias("x"), F.xxhash64(F.lit(1), text_col).alias("y")]


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """(d, x, y, gone, near): per id and text the numbers of the lines to remove, and how many of them are near copies only."""
    short_batches(docs.sparkSession)
    rows = docs.select(*_row_key(id_col, text_col), F.col(text_col).alias("t"))
    where = written(rows.mapInArrow(_occurrences, "d bigint, x bigint, y bigint, i int, h bigint, g bigint"), "occurrences")
    place = F.struct("d", "x", "y", "i")
    first = where.groupBy("h", "g").agg(F.min(place).alias("o"), F.count("*").alias("n"))
    near = near_lines(rows.select("t"), first.select("h", "g", "o.d", "o.x", "o.i"), rule)
    marked = first.join(near.withColumn("near", F.lit(True)), ["h", "g"], "left").where("n > 1 or near").select("h", "g", "o", F.coalesce("near", F.lit(False)).alias("near"))
    marked = small(written(marked, "marked"), BROADCAST_ROWS)
    hits = where.join(marked, ["h", "g"]).where(F.col("near") | (place != F.col("o")))
    alone = F.when(F.col("near") & (place == F.col("o")), F.col("i"))
    return hits.groupBy("d", "x", "y").agg(F.collect_set("i").alias("gone"), F.count_distinct(alone).alias("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """(row, n_lines, n_removed, n_near): rows of ``docs`` without lines that an earlier one repeats; n_chars follows the text.

    Lines are compared without the white space around them.  A line goes if the
    same line, or one that is near to it by the ``rule``, stands earlier: in a
    document of smaller id, or above it.  Equal are lines
    of one hash of 128 bits.
    Blank lines part paragraphs and stay.  A null or empty text stays as it is; a document whose
    lines all go keeps an empty text.  A document is a row's id and text: texts
    that share an id, or have none, are documents of their own, in the order of
    their hashes, a null id before all others.  Rows that repeat both are one
    document and lose the same lines.  Texts are read whole however long; other
    columns are carried along, whatever they are called; an empty table gives no rows.
    """
    gone = removals(docs, id_col, text_col, rule).withColumnsRenamed({"d": "_d", "x": "_x", "y": "_y"})
    rows = docs.select(*_row_key(id_col, text_col), F.struct(*docs.columns).alias("row"))
    out = rows.join(gone, (F.col("d") == F.col("_d")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left")
    text = F.col("row").getField(text_col)
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("gone", i)), "\n")
    row = F.when(F.col("gone").isNull(), F.col("row")).otherwise(F.col("row").withField(text_col, kept))
    if "n_chars" in docs.columns:
        row = F.when(F.col("gone").isNull(), F.col("row")).otherwise(row.withField("n_chars", F.length(kept).cast("long")))
    n = F.when(F.length(text) > 0, F.size(lines)).otherwise(0).cast("long")
    counts = {"n_lines": n, "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long"), "n_near": F.coalesce("near", F.lit(0)).cast("long")}
    return out.select(row.alias("row"), *[c.alias(k) for k, c in counts.items()])


def op7_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines every document loses, and a checksum of what is left; awkward rows as in ``dedup_lines``."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", "n_near", F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("kept_crc32"))
