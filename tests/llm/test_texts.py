"""Tokens, packing, repeats, lines and fingerprints against plain versions, over awkward tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lines, packing, simhash, substrings, tokenfile
from millrace.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


@pytest.fixture(params=["edges", "clashing", "nothing", "sf"])
def docs(request, spark):
    return spark.read.parquet(f"{SF}/documents.parquet") if request.param == "sf" else request.getfixturevalue(request.param)


def rows(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0], r[1] is not None, r[1] or ""))


def ids_of(encoder, text, end):
    """The library's own ids of a whole text."""
    return np.array([*encoder.library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoder_is_the_library(encoder):
    rnd = random.Random(4)
    parts = ["a", "b ", " ", "\n", "  ", "\t", ".", ",", "the ", "é", "<|endoftext|>", "'s", "1", " ", "\x85", "!", "　", "\x1c", "ª", "ß "]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(3000)]
    assert encoder.encode(texts) == encoder._whole(texts)
    assert encoder.encode([None, ""]) == [b"", b""]


def test_blocks_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 63, 1024, 1025, 5000):
        for ids in (rnd.integers(0, 50_000, n), rnd.integers(0, 2**32, n), np.full(n, 7), np.where(rnd.random(n) < 0.05, 2**31, rnd.integers(0, 9, n))):
            data, starts = tokenfile.encode_blocks(ids.astype("<u4"))
            assert (tokenfile.decode_blocks(data, starts) == ids.astype(np.uint32)).all()


def test_token_file(spark, docs, encoder, tmp_path):
    tokenfile.write_tokens(docs, f"file://{tmp_path}/t")
    got = sorted(map(tuple, tokenfile.digests(spark, f"file://{tmp_path}/t").collect()))
    want, at = [], 0
    for d, t in rows(docs):
        ids = ids_of(encoder, t, 2)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)


def test_packing(docs, encoder):
    pieces = packing.pack(docs).collect()
    left = Counter()
    for d, t in rows(docs):
        ids = ids_of(encoder, t, 0)
        left[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    by_sequence: dict = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for held in by_sequence.values():
        held.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in held] == [sum(q["length"] for q in held[:i]) for i in range(len(held))]
        assert sum(p["length"] for p in held) <= packing.LENGTH
    text = {d: ids_of(encoder, t, 0) for d, t in rows(docs)}
    covered = Counter()
    for p in pieces:
        assert zlib.crc32(text[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(text[p["doc_id"]])
        covered[p["doc_id"]] += p["length"]
    assert covered == Counter({d: sum(n * k for (e, n, _), k in left.items() if e == d) for d in text})


def test_cuts_are_cheapest():
    """Against all ways to cut a short stream."""
    rnd = random.Random(2)

    def best(pos, cost, length):
        n = len(pos)
        value = [float("inf")] * n
        for j in range(n):
            for i in range(-1, j):
                size = pos[j] - (pos[i] if i >= 0 else 0)
                if size <= length:
                    value[j] = min(value[j], (value[i] if i >= 0 else 0) + cost[j] + (length - size if j < n - 1 else 0))
        return value[-1]

    for _ in range(200):
        pos = np.cumsum([rnd.randint(1, 7) for _ in range(rnd.randint(1, 14))])
        cost = np.array([rnd.choice([0, 2, 6]) for _ in pos])
        got, total = packing.cuts(pos, cost, 10), 0
        for a, b in zip([-1, *got], got):
            size = pos[b] - (pos[a] if a >= 0 else 0)
            assert size <= 10
            total += cost[b] + (10 - size if b < len(pos) - 1 else 0)
        assert total == best(pos.tolist(), cost.tolist(), 10)


def brute_repeats(docs, length=200):
    seen = Counter(t[i : i + length] for _, t in docs for i in range(len(t) - length + 1))
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, x in zip(t, gone) if not x)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats(docs):
    got = sorted(map(tuple, substrings.remove_repeats(docs).drop("kept").collect()))
    assert got == brute_repeats([(d, (t or "").encode()) for d, t in rows(docs)])


@pytest.mark.parametrize("most", [1 << 15, 4])
def test_repeats_of_passages(spark, monkeypatch, most):
    """Passages with edits in many places; with few allowed together, anchors are too common to sort around."""
    monkeypatch.setattr(substrings, "MOST", most)
    rnd = random.Random(3)
    passages = ["".join(rnd.choices("abcdefgh ", k=rnd.randint(150, 420))) for _ in range(8)]

    def edited(s):
        s = list(s)
        for _ in range(rnd.choice([0, 0, 1, 2])):
            s[rnd.randrange(len(s))] = "Z"
        return "".join(s)

    table = [(i, "".join(edited(rnd.choice(passages)) if rnd.random() < 0.6 else "".join(rnd.choices("xyz", k=rnd.randint(1, 200))) for _ in range(rnd.randint(0, 6)))) for i in range(80)]
    table += [(1000, "a" * 700), (1001, "ab" * 300), (1002, "q" * 250 + passages[0]), (1003, table[5][1]), (1005, "é" * 150)]
    got = sorted(map(tuple, substrings.remove_repeats(spark.createDataFrame(table, "doc_id long, text string")).drop("kept").collect()))
    assert got == brute_repeats([(d, t.encode()) for d, t in table])


def test_repeats_of_very_long_texts(spark):
    """Texts beyond the positions that a buffer counts: passages within one, across the bounds of its parts, and in another text."""
    rnd = np.random.default_rng(6)
    size, passage = (1 << 24) + 300_000, rnd.integers(97, 123, 300, np.uint8)
    big = rnd.integers(97, 123, size, np.uint8)
    places = [1000, (1 << 23) - 150, 2 * (1 << 23) - 50, size - 300]
    for k, a in enumerate(places):
        big[a : a + 300] = passage
        if a > 0:
            big[a - 1] = 48 + k  # what stands beside it differs
        if a + 300 < size:
            big[a + 300] = 48 + k
    other = np.concatenate([[57], passage[20:240], [56]]).astype(np.uint8)
    docs = [(1, big.tobytes().decode()), (2, other.tobytes().decode()), (3, "short")]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), keep=False).collect()}
    gone = np.zeros(size, bool)
    for a in places:
        gone[a : a + 300] = True
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {1: (size, 1200, 4, digest(big[~gone].tobytes())), 2: (222, 220, 1, digest(b"98")), 3: (5, 0, 0, digest(b"short"))}


def test_plans_and_chunks_of_long_texts(spark, monkeypatch, encoder, tmp_path):
    """Texts of more tokens than a chunk of the file or a plan of the packing holds."""
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(500)]
    docs = spark.createDataFrame([(1, "one"), (2, ". ".join(rnd.choices(words, k=450_000))), (3, None), (4, " ".join(rnd.choices(words, k=90_000)))], "doc_id long, text string").coalesce(1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {d: ids_of(encoder, t, 2) for d, t in texts.items()}
    assert len(ids[2]) > packing.PLAN and len(ids[4]) > 2 * tokenfile.CHUNK
    tokenfile.write_tokens(docs, f"file://{tmp_path}/t")
    got = sorted(map(tuple, tokenfile.digests(spark, f"file://{tmp_path}/t").collect()))
    starts = np.cumsum([0] + [len(ids[d]) for d in (1, 2, 3, 4)])
    assert got == [(d, int(starts[d - 1]), len(ids[d]), zlib.crc32(ids[d].tobytes())) for d in (1, 2, 3, 4)]
    pieces = packing.pack(docs).collect()
    sizes = Counter()
    for d in texts:
        own = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == d)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) == len(ids[d])
    for p in pieces:
        sizes[p["sequence_id"]] += p["length"]
    assert max(sizes.values()) <= 1024 and sum(sizes.values()) > 0.97 * 1024 * len(sizes)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_bit_vectors():
    rnd = random.Random(1)
    for _ in range(4000):
        a, b = ("".join(rnd.choices("abc"[: rnd.randint(1, 3)], k=rnd.randint(0, 9))) for _ in range(2))
        for most in (0, 1, 2, 3, 5):
            assert lines.within(a, b, most) == (distance(a, b) <= most)


def check_lines(df, rule=lines.RULE):
    keyed = [tuple(r) for r in df.selectExpr("doc_id", "text", "xxhash64(text) x").collect()]
    order = lambda d: -(1 << 63) if d is None else d
    docs = {(d, t, x) for d, t, x in keyed if t}
    place = sorted({(order(d), x, i, line.strip(), d, t) for d, t, x in docs for i, line in enumerate(t.split("\n")) if line.strip()}, key=lambda p: p[:3])
    gone, near, seen = {}, Counter(), []
    for *_, i, line, d, t in place:
        if line in seen:
            gone.setdefault((d, t), set()).add(i)
            continue
        if len(line) >= rule.least and any(distance(line, y) <= rule.edits(min(len(line), len(y))) for y in seen if min(len(line), len(y)) >= rule.least and abs(len(line) - len(y)) <= rule.most):
            gone.setdefault((d, t), set()).add(i)
            near[d, t] += 1
        seen.append(line)
    got = lines.dedup_lines(df, rule=rule).select("row.doc_id", "row.text", "n_removed", "n_near").collect()
    want = [(d, t and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ())), len(gone.get((d, t), ())), near[d, t]) for d, t, _ in keyed]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_lines_of_texts_that_share_an_id_or_have_none(spark):
    """A line's number in one text says nothing of other texts of the id, and texts without an id are each their own."""
    common = "This line stands in many of the documents here"
    texts = [(None, f"{common}\nNobody else has these particular closing words at all"), (None, f"Another opening that nobody else has at all\n{common}"), (None, f"This line of the third document is its own and unique\n{common} \nshort"),
             (7, f"{common}!\nSecond text of seven, a line that is only here"), (7, f"A text of seven whose first line is its own\n{common}"), (7, f"A text of seven whose first line is its own\n{common}"), (8, f"short\n{common}"), (None, None), (7, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    check_lines(df)
    left = "\n".join(r["text"] or "" for r in lines.dedup_lines(df).select("row.text").collect())
    assert all(x in left for _, t in texts for x in (t or "").split("\n") if common not in x)


@pytest.mark.parametrize("name", ["edges", "clashing", "nothing"])
def test_lines(request, name):
    check_lines(request.getfixturevalue(name))


@pytest.mark.parametrize(("pairwise", "most"), [(64, 1), (64, 3), (3, 1), (3, 2), (2, 2), (2, 3)])
def test_lines_up_to_a_threshold(spark, monkeypatch, pairwise, most):
    """For several thresholds, also with groups of more lines than are compared in pairs."""
    monkeypatch.setattr(lines, "PAIRWISE", pairwise)
    rnd = random.Random(1)
    base = ["".join(rnd.choices("abcdef", k=rnd.choice([20, 23, 26, 36, 41]))) for _ in range(4)]

    def edited(s):
        s = list(s)
        for _ in range(rnd.randint(0, most + 1)):
            p = rnd.randrange(len(s))
            s[p : p + rnd.randint(0, 1)] = rnd.choice(["", "a", "b"])
        return "".join(s)

    check_lines(spark.createDataFrame([(i, "\n".join(edited(rnd.choice(base)) for _ in range(rnd.randint(0, 6)))) for i in range(40)], "doc_id long, text string"), lines.Rule(most, 12, 20))


def test_segments_of_near_lines_meet():
    """Every pair within the threshold is in one group whose pieces are near, and lines of numbers divide until all is settled."""
    rule = lines.Rule(3, 8, 20)
    rnd = random.Random(3)

    def groups(line):
        data = {}
        for a, b, seed, part in lines.looks(rule, len(line))[0]:
            key = hash((line[a:b], seed)) >> 1
            for k, role, pieces in lines.opened(rule, key, part, line):
                data.setdefault(k, []).append((role, pieces))
        return data

    near = 0
    for _ in range(600):
        a = "".join(rnd.choices("ab", k=rnd.randint(20, 34)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            p = rnd.randrange(len(b))
            b[p : p + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "c"])
        b = "".join(b)
        if len(b) < 20:
            continue
        x, y = groups(a), groups(b)
        met = any(all(lines.within(p[0], q[0], p[1]) for p, q in zip(ps, qs)) for k in x.keys() & y.keys() for r, ps in x[k] for s, qs in y[k] if r == s == lines.SAME or {r, s} == {lines.SHORTER, lines.LONGER})
        assert met == (distance(a, b) <= rule.edits(min(len(a), len(b))))
        near += met
    assert near > 200


def test_a_hot_template_divides(spark):
    """Thousands of lines that differ in a number only are not paired off."""
    docs = [(i, f"The number of the page that you have asked for is {i:05d}, thank you.") for i in range(0, 4500, 3)]
    seen = []
    got = {r["doc_id"]: r["n_near"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("row.doc_id", "n_near").collect()}
    texts = {}
    for d, t in docs:
        number = f"{d:05d}"
        seen.append(number)
        texts[d] = any(sum(a != b for a, b in zip(number, x)) <= 2 or distance(number, x) <= 2 for x in seen[:-1])
    assert got == {d: int(x) for d, x in texts.items()}


def test_fingerprints(docs):
    import re

    import xxhash

    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    prints = {}
    for d, t in rows(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[d] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    ids = sorted(prints)
    least = {d: d for d in ids}
    while True:
        new = {d: min(least[e] for e in ids if (prints[d] ^ prints[e]).bit_count() <= 2) for d in ids}
        if new == least:
            break
        least = new
    assert got == {(d, f"{prints[d]:016x}"): least[d] for d in ids}


@pytest.mark.parametrize("levels", [2, 3, 4, 6, 8])
def test_tree_finds_every_near_pair(spark, monkeypatch, levels):
    monkeypatch.setattr(simhash, "LEVELS", ((1 << 63, levels),))
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(12)})
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    from millrace.llm.components import components

    root = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    of = {p: p for p in prints}
    while True:
        new = {p: min(of[q] for q in prints if (p ^ q).bit_count() <= 2) for p in prints}
        if new == of:
            break
        of = new
    groups = lambda f: sorted(sorted(q for q in prints if f(q) == v) for v in {f(p) for p in prints})
    assert groups(lambda p: root.get(simhash._signed(p), simhash._signed(p))) == groups(lambda p: of[p])
