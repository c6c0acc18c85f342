"""Lines of every length."""

import random

import pytest

from millrace.llm import lines


def test_short_lines_go_as_exact_copies_only(spark):
    docs = [(1, "Home\n\nContact\nHome"), (2, " Contact \n\nContacts\nx"), (3, "x"), (4, "\n\n")]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("row.doc_id", "row.text", "n_removed", "n_near").collect()
    assert sorted(map(tuple, got)) == [(1, "Home\n\nContact", 1, 0), (2, "\nContacts\nx", 1, 0), (3, "", 1, 0), (4, "\n\n", 0, 0)]


def test_keys_are_made_once_and_read_back():
    """Those of all lines, from whole columns, slices and batches without rows; in order, with their parts."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    texts = ["A line of plain words that is long enough\nshort\n Än line with other letters, überlang ", None, "", "x" * 25 + "\nA line of plain words that is long enough"]
    found = list(dict.fromkeys(x.strip() for t in texts for x in (t or "").split("\n") if len(x.strip()) >= 20))
    want = [(xxhash.xxh64_intdigest(x[a:b].encode(), seed), *lines.line_hash(x), part) for x in found for a, b, seed, part in lines.looks(lines.RULE, len(x))[0]]
    want = [(k - (1 << 64) * (k >> 63), h, g, p) for k, h, g, p in want]
    (hashed,) = lines._line_keys(lines.RULE)(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])]))
    rows = lambda batches, **how: [tuple(r.values()) for b in lines._keys(lines.RULE, **how)(iter(batches)) for r in b.to_pylist()]
    assert rows([hashed], whole=True) == rows([hashed.slice(0, 1), hashed.slice(1, 0), hashed.slice(1)], whole=True) == want
    assert rows([hashed]) == [(k, h, p) for k, h, _, p in want]
    held = np.sort(np.array([want[0][0], want[-1][0]]))
    assert rows([hashed], shared=held) == [(k, h, p) for k, h, _, p in want if k in held]
    assert rows([hashed], shared=held[:0]) == []
    # Lines that no key is made for.
    rule = lines.Rule(2, 60, 20)
    (none,) = lines._line_keys(rule)(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])]))
    assert none.num_rows == len(found) and sum(b.num_rows for b in lines._keys(rule)(iter([none]))) == 0


def test_comparisons_end_when_lines_are_told_apart():
    import random

    class Read(str):
        """A text that counts the characters it is asked for one after another."""

        n = 0

        def __getitem__(self, at):
            return Read(super().__getitem__(at))

        def __iter__(self):
            for c in str(self):
                Read.n += 1
                yield c

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rnd = random.Random(2)
    for _ in range(20_000):
        a = rnd.choices("abc"[: rnd.randint(1, 3)], k=rnd.randint(0, 14))
        b = list(a) if rnd.random() < 0.8 else rnd.choices("abc", k=rnd.randint(0, 14))
        for _ in range(rnd.randint(0, 4)):
            p = rnd.randint(0, len(b))
            b[p : p + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "cb"])
        a, b = "".join(a), "".join(b)
        d = distance(a, b)
        assert [lines.within(a, b, k) for k in range(5)] == [d <= k for k in range(5)], (a, b)
    assert not lines.within("a" * 1000, Read("b" * 1000), 2) and Read.n < 20
    assert not lines.within("a" * 1000, Read("b" * 1000), 1) and Read.n < 20


def near_copies(n):
    """One text with three edits each, so that two of the copies are hardly ever near, and some of them with one edit more."""
    rnd = random.Random(5)
    base = "".join(rnd.choices("abcdefghij  ", k=150))
    out = []
    for _ in range(n):
        s = list(out[-1] if out and rnd.random() < 0.2 else base)
        for _ in range(1 if "".join(s) != base else 3):
            p = rnd.randrange(1, 149)
            s[p : p + rnd.randint(0, 1)] = rnd.choice("klm")
        out.append("".join(s))
    return list(dict.fromkeys(out))


def late_of(texts):
    return {i for i, t in enumerate(texts) if any(lines.within(t, u, lines.RULE.edits(min(len(t), len(u)))) for u in texts[:i])}


@pytest.mark.parametrize(("inside", "rounds"), [(lines.INSIDE, 1), (64, None)])
def test_groups_of_near_copies_divide_within_a_task(spark, monkeypatch, inside, rounds):
    """They need one round of jobs; those that are too large for a task need more, and give the same rows."""
    names = []
    monkeypatch.setattr(lines, "INSIDE", inside)
    monkeypatch.setattr(lines, "written", lambda df, name, *a, f=lines.written: (names.append(name), f(df, name, *a))[1])
    texts = near_copies(400)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    late = {r["doc_id"] for r in lines.dedup_lines(df).where("n_near > 0").select("row.doc_id").collect()}
    assert late == late_of(texts) and 30 < len(late) < len(texts) / 2
    assert names.count("groups") == rounds if rounds else names.count("groups") > 1


@pytest.mark.parametrize("pairwise", [1, 3, 64, 1000])
def test_groups_in_a_task_are_searched_whole(pairwise):
    """However far they divide before lines are compared; lines that are shorter and longer by an edit or two among them."""
    texts = near_copies(120) + [f"The page that you have asked for is {i:03d}." for i in range(0, 300, 7)] + [f"The page that you have asked for is {i}!" for i in range(0, 40, 3)]
    groups = {}
    for i, t in enumerate(texts):
        for a, b, seed, part in lines.looks(lines.RULE, len(t))[0]:
            for key, role, pieces in lines.opened(lines.RULE, hash((t[a:b], seed)) >> 1, part, t):
                groups.setdefault(key, []).append(((i, 0, 0, i, i), role, pieces))
    late = set()
    for key, members in groups.items():
        lines._search(key, members, late, pairwise)
    assert {h for h, _ in late} == late_of(texts)
