"""One-permutation MinHash against brute force over all pairs."""

import random

import numpy as np
import pytest

from millrace.llm import minhash


def plain(docs, words=4):
    """(id, n, least) of every row: components of pairs at 0.8 or more."""
    split = [(d, (t or "").encode().lower().split()) for d, t in docs]
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set() for _, w in split]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(split):
        ids = [e for j, (e, _) in enumerate(split) if find(j) == find(i) and e is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr)


def varied(seed, groups, sizes):
    """Texts with words changed, around the threshold and on both sides of it, and groups that only chains connect."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(groups):
        texts.append(rnd.choices([f"w{i}" for i in range(3000)], k=rnd.choice(sizes)))
        base = texts[-1]
        for _ in range(rnd.randint(1, 4)):
            copy = list(rnd.choice([base, texts[-1]]))
            for p in rnd.sample(range(len(copy)), min(len(copy), rnd.randint(0, max(1, len(copy) // 40)))):
                copy[p] = f"w{rnd.randrange(3000)}"
            texts.append(copy[: rnd.choice([len(copy), len(copy), len(copy) - 1])])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_every_link_is_found(spark):
    docs = varied(3, 60, [5, 9, 20, 60, 200, 500])
    want = plain(docs)
    assert 40 < len({r[2] for r in want}) < len(docs) - 40
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == want


def test_members_that_are_unlike_their_hub(spark, monkeypatch):
    """Variants of one text on both sides of the threshold share buckets whose stars do not connect them; blocks of a few."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(70)]
    docs = []
    for i in range(60):
        copy = list(base)
        for p in rnd.sample(range(70), rnd.randint(1, 3)):
            copy[p] = f"x{rnd.randrange(2)}"
        docs.append((i, " ".join(copy)))
    want = plain(docs)
    assert 1 < len({r[2] for r in want}) < 60
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == want


@pytest.mark.parametrize("name", ["edges", "clashing", "nothing"])
def test_awkward_rows(request, name):
    df = request.getfixturevalue(name)
    assert found(df) == plain([(r["doc_id"], r["text"]) for r in df.collect()])


def test_ids_that_repeat_or_lack(spark):
    """Rows of one id are rows of their own; a null id is never the least unless there is no other."""
    docs = [(None, "A b c d e f g"), (None, "a B c d e f g"), (5, "a b c d e f g"), (5, "something else in here"), (None, "only texts without ids"), (None, "only texts without ids"), (None, ""), (3, None), (3, "one"), (4, "ONE"), (None, "two")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert found(df) == plain(docs)


def test_sketches_agree_as_sets_do():
    """The share of bins that agree is near the similarity, for sets that fill few bins and for large ones."""
    rng = np.random.default_rng(1)
    for size in (4, 20, 150, 3000):
        shares = []
        for _ in range(200):
            x = rng.integers(0, 1 << 63, size * 5 // 4, np.uint64)
            shares.append((minhash.sketch(np.sort(x[:size])) == minhash.sketch(np.sort(x))).mean())
        assert abs(np.mean(shares) - size / (size * 5 // 4)) < 0.02
