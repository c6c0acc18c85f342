"""The prefix trie against a plain one, over awkward and very long conversations."""

import hashlib
import random
import zlib

import pytest

from millrace.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    whole = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(convs.get(base, [])[:h] + convs[c][h:])
    nodes = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            kids[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if whole[c] == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in nodes.items())


def check(spark, rows, parts=3):
    got = sorted(map(tuple, trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()))
    assert got == plain(rows)


def varied(rnd, n, most):
    """Conversations that share beginnings, some of all their turns."""
    rows, known = [], [[]]
    for c in range(n):
        begin = rnd.choice(known)
        s = begin[: rnd.randint(0, len(begin))] + [(rnd.choice("ua"), f"t{rnd.randrange(3)}" * rnd.randint(0, 2)) for _ in range(rnd.randint(1, most))]
        known.append(s)
        rows += [(c * 7 % 400, i, *t) for i, t in enumerate(s)]
    return rows


@pytest.mark.parametrize(("levels", "size"), [(16, 100_000), (2, 12), (3, 0), (1, 100_000)])
def test_trie(spark, monkeypatch, levels, size):
    """Peeled by jobs, in tasks, and as chains, with subtrees too large for a task."""
    monkeypatch.setattr(trie, "LEVELS", levels)
    monkeypatch.setattr(trie, "TASK_TURNS", size)
    rnd = random.Random(4)
    rows = varied(rnd, 60, 3)
    rows += [(c, i, "u", "very common" if i < 9 else f"end {c}") for c in range(500, 512) for i in range(10)]
    rows += [(c, i, "u", f"turn {i}") for c in (600, 700, 801) for i in range(7)]
    check(spark, rows)


def test_long_conversations(spark, monkeypatch):
    """Hundreds of turns cost no job each; lists of ids are hashed in chunks."""
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = [(c, i, "u", "same" if i < 120 else f"{c} {i}") for c in (1, 2, 3) for i in range(180)]
    rows += [(c, i, "a", "x" * i) for c in (7, 100) for i in range(250)]
    rows += [(c, 0, "u", "hello") for c in range(1000, 1030)]
    check(spark, rows)


def test_awkward_rows(spark):
    """Nulls in every column, rows that repeat, large, negative and missing ids, conversations that are left without turns."""
    rows = [(0, None, None, None), (0, 1, "u", None), (0, 2, "a", "naïve 日本語"), (1, 1, "u", "x"), (1, 1, "u", "x"), (None, 0, "u", "lost"), (-5, 0, "u", "minus"), (-105, 3, "u", "minus"), (-100, 0, "u", "first")]
    rows += [(c, 0, "u", "only turn") for c in (301, 302, 303, 304)] + [(9_000_000_000_000_000_123, 5, "a", "y" * 5000), (9_000_000_000_000_000_123, None, "a", ""), (205, 1, "", "")]
    check(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.selectExpr("*", "1 as a", "2 as b", "3 as c", "4 as depth", "5 as n", "6 as x", "7 as part")
    assert sorted(map(tuple, trie.prefix_trie(clashing).collect())) == plain(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0
