"""The pipeline's near-dedup stage against brute force over pairs."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in texts], SCHEMA).repartition(3)


def plain(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def survivors(texts):
    """Ids that stay: the least of each component of pairs at 0.8 or more."""
    sets = [(i, plain(t)) for i, t in sorted(texts)]
    least = {i: i for i, _ in sets}
    pairs = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if alike(a, b)]
    while True:
        new = dict(least)
        for i, j in pairs:
            new[i] = new[j] = min(new[i], new[j])
        if new == least:
            return sorted(set(least.values())), len(pairs)
        least = new


def test_every_pair_of_near_copies_is_found(spark):
    """Copies with words changed, around the threshold and on both sides of it, and groups that only chains connect."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = rnd.choices(words, k=rnd.choice([30, 80, 200, 400]))
        texts.append(base)
        for _ in range(rnd.randint(1, 4)):
            copy = list(rnd.choice([base, texts[-1]]))
            for p in rnd.sample(range(len(copy)), rnd.randint(0, len(copy) // 25)):
                copy[p] = rnd.choice(words)
            texts.append(copy)
    texts = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, "Short one"), (9001, "short ONE"), (9002, "short two"), (9003, ""), (9004, None)]
    want, pairs = survivors(texts)
    assert pairs > 100 and len(want) < len(texts) - 50
    got = corpus_pipeline.near_copies(spark, table(spark, texts), "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == want


def test_rows_are_told_apart_by_id_and_text(spark):
    """Ids that repeat, and null ids, cost no other text; near copies of null ids go."""
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    a, b, c, d, e = (" ".join(rnd.choices(words, k=60)) for _ in range(5))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    texts = [(1, a), (1, b), (1, a), (None, c), (None, d), (None, near(a)), (2, e), (3, near(b)), (3, near(e)), (3, "a text of its own")]
    got = corpus_pipeline.near_copies(spark, table(spark, texts), "").select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, a), (1, b), (None, c), (None, d), (2, e), (3, "a text of its own")]))


def test_blocks_of_a_band_meet(spark, monkeypatch):
    """Bands of many texts on both sides of the threshold, in blocks of a few."""
    from millrace.llm import shingles

    monkeypatch.setattr(shingles, "BLOCK", 4)
    monkeypatch.setattr(shingles, "COLUMNS", 16)
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        copy = list(base)
        for p in rnd.sample(range(60), rnd.randint(1, 3)):
            copy[p] = f"x{rnd.randrange(2)}"
        texts.append((i, " ".join(copy)))
    want, _ = survivors(texts)
    assert 1 < len(want) < 60
    got = corpus_pipeline.near_copies(spark, table(spark, texts), "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == want
