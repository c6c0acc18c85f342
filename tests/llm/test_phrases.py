"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from millrace.llm import phrases

SCHEMA = "lang string, text string"


def plain(docs, least, top):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        wanted = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in wanted.items():
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= 80 * a for q, b in wanted.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def check(df, least, top, **more):
    got = sorted(map(tuple, phrases.collocations(df, least=least, top=top, **more).collect()))
    assert got == plain([(r["lang"], r["text"]) for r in df.collect()], least, top)
    return got


@pytest.mark.parametrize("numbered", [1000, 0])
def test_phrases(spark, numbered):
    """Words by number and as strings; the report cut where scores tie; words that contain marks of their own."""
    rnd = random.Random(2)
    words = ["a", "b", "Bb", "c", "日本", "é", "x\x01y", "d-e", "(f)", "\xa0", "\x1c"] + [f"rare{i}" for i in range(40)]
    text = lambda: "".join(rnd.choice(words[: rnd.choice([4, 11, 51])]) + rnd.choice([" ", " ", "  ", "\t", ", ", ".\n", " \x0b"]) for _ in range(rnd.randint(0, 60)))
    docs = [(rnd.choice(["en", "en", "de", None, "und"]), text()) for _ in range(120)] + [("en", None), ("en", ""), ("fr", ".,;"), (None, None)]
    docs += [("en", "New York City Hall is new york city hall")] * 8
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert len(check(df, 4, 25, numbered=numbered)) > 60


@pytest.mark.parametrize("name", ["edges", "clashing", "nothing"])
def test_awkward_rows(request, name):
    check(request.getfixturevalue(name), 2, 50)


def test_windows_stop_at_ends(spark):
    """No phrase runs from one piece or document into the next, and parts of a longer phrase go with it."""
    got = check(spark.createDataFrame([("en", "a b. c d"), ("en", "a b\rc d"), ("en", "a b c d e"), ("en", "a b c d e")], SCHEMA), 2, 50)
    assert {r[2] for r in got} == {"a b", "c d", "a b c d", "b c d e"}
