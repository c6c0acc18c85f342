"""The classifier against plain versions: the model, perplexities, windows, thresholds and verdicts."""

from collections import Counter

import numpy as np
import pytest

from millrace.llm import quality
from millrace.llm.tokens import Encoder, tokenizer_path


def plain_model(counts, size):
    """Log probability of any trigram by the textbook, from counts of trigrams."""
    two = Counter((v, w) for _, v, w in counts)
    one = Counter(w for _, w in two)

    def discount(c):
        n = [0] + [sum(1 for x in c.values() if x == k) for k in range(1, 5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0 for k in (1, 2, 3)]
        return [0.0] + [x if 0 < x < k else 0.5 * k for k, x in zip((1, 2, 3), d)]

    d3, d2, d1 = discount(counts), discount(two), discount(one)
    n1 = sum(one.values())
    g1 = sum(d1[min(c, 3)] for c in one.values()) / n1

    def inside(table):
        out = {}
        for k, c in table.items():
            out.setdefault(k[:-1], []).append(c)
        return out

    in3, in2 = inside(counts), inside(two)

    def back(table, d, entry, within, lower):
        if within is None:
            return lower
        c = table.get(entry, 0)
        return ((c - d[min(c, 3)]) if c else 0) / sum(within) + sum(d[min(x, 3)] for x in within) / sum(within) * lower

    def p(u, v, w):
        p1 = (one[w] - d1[min(one[w], 3)] if w in one else 0) / n1 + g1 / size
        p2 = back(two, d2, (v, w), in2.get((v,)), p1)
        return np.log(back(counts, d3, (u, v, w), in3.get((u, v)), p2))

    return p


def trigrams(e, text):
    t = [0, 0, *(i + 1 for i in e.library.encode(text or "", add_special_tokens=False).ids)]
    return list(zip(t, t[1:], t[2:]))


@pytest.fixture(scope="module")
def corpus():
    rnd = np.random.default_rng(4)
    words = ["".join(rnd.choice(list("aeioulmnrst"), rnd.integers(2, 7))) for _ in range(60)]
    junk = ["%%%", "| x |", "ZQX!!", "\u00e9\u00e8"]
    docs, labels = [], []
    for i in range(160):
        lang = ["en", "de", None, "sv"][i % 4] if i < 150 else "once"
        clean = i % 5 > 0
        n = int(rnd.integers(1, 90))
        text = " ".join(rnd.choice(words if clean else junk, n))
        docs.append((i, text, lang))
        if i < 120 or i == 150:
            labels.append((i, int(clean), int(i % 11 == 0)))
    docs += [(500, None, "en"), (501, "", "de"), (3, docs[3][1], docs[3][2]), (None, "a b c d", "en"), (502, "never seen", "xx")]
    return docs, labels


@pytest.mark.parametrize("most", [quality.MODEL_ROWS, 0])
def test_classifier_equals_a_plain_one(spark, monkeypatch, corpus, most):
    """Whether the model is held by every worker or joined by shuffles."""
    monkeypatch.setattr(quality, "MODEL_ROWS", most)
    monkeypatch.setattr(quality, "MANY", 60)
    monkeypatch.setattr(quality, "SOME", 5)
    docs, labels = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    out = quality.classified(*quality.perplexities(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held_out=4), quantile=0.9).collect()
    e = Encoder(tokenizer_path())
    good = {i for i, q, t in labels if q == 1 and not t}
    assert {r["id"] for r in out if r["trusted"]} == good & {d[0] for d in docs}
    assert all(not r["held_out"] or r["trusted"] for r in out)
    text = {(d, lang): t for d, t, lang in docs}
    counts, checked, verdicts = {}, 0, Counter()
    for lang in {r["lang"] for r in out if r["trusted"] and not r["held_out"]}:
        counts[lang] = Counter(g for r in out if r["lang"] == lang and r["trusted"] and not r["held_out"] for g in trigrams(e, text[r["id"], lang]))
    model = {lang: plain_model(c, e.size) for lang, c in counts.items()}
    # Every held-out text gives all its windows of each length.
    held = {}
    for r in out:
        if r["held_out"] and r["lang"] in model:
            g = trigrams(e, text[r["id"], r["lang"]])
            k = 1
            while 4**k <= len(g):
                for at in range(0, len(g) - 4**k + 1, 4**k):
                    held.setdefault((r["lang"], k), []).append(np.exp(-np.mean([model[r["lang"]](*x) for x in g[at : at + 4**k]])))
                k += 1
    bounds, ways = {}, Counter()
    for (lang, k), v in sorted(held.items(), key=repr):
        if len(v) >= 60 or k == 1:
            own = sorted(v)[int(np.ceil(0.9 * len(v))) - 1]
        elif len(v) >= 5:
            own = np.exp(np.mean(np.log(v)) + 1.2815515655446004 * np.std(np.log(v)))
        else:
            continue
        ways[len(v) >= 60] += 1
        bounds[lang, k] = min(own, bounds.get((lang, k - 1), own))
    assert ways[True] >= 3 and ways[False] >= 2, ways
    for r in out:
        g = trigrams(e, text[r["id"], r["lang"]])
        assert r["tokens"] == (len(g) if r["lang"] in model else 0) or r["tokens"] == 0 and not g
        if r["lang"] not in model or not g:
            assert r["perplexity"] is None and r["keep"]
            continue
        want = np.exp(-np.mean([model[r["lang"]](*x) for x in g]))
        assert abs(r["perplexity"] / want - 1) < 1e-4
        usable = [k for lang, k in bounds if lang == r["lang"] and 4**k <= max(4, len(g))]
        if not usable:
            assert r["threshold"] is None and r["keep"]
            continue
        assert abs(r["threshold"] / bounds[r["lang"], max(usable)] - 1) < 1e-4
        assert r["keep"] == (r["perplexity"] <= r["threshold"])
        verdicts[r["keep"], r["id"] is not None and r["id"] < 150 and r["id"] % 5 > 0] += 1
        checked += 1
    assert checked > 100 and verdicts[False, False] > 15 and verdicts[True, True] > 60
    once = [r for r in out if r["lang"] == "once"]
    assert all(not r["held_out"] and r["keep"] for r in once)


def test_unlike_words_are_unlike_tokens():
    e = Encoder(tokenizer_path())
    words = ["hello", "xqzvk", "government", "zzzzzzzzzz", "Hello", "12345", "12346"]
    assert len({tuple(quality.keys_of([w], e)[0].tolist()) for w in words}) == len(words)


def test_counts_of_a_task_are_whole(monkeypatch):
    """However often a task gives away what it holds."""
    import pyarrow as pa

    texts = [("en", "a b a b a b"), ("de", "a b"), (None, "b a b"), ("en", None), ("en", "b a")] * 40
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts]), pa.array([t for _, t in texts])], names=["lang", "text"])
    e = Encoder(tokenizer_path())
    want = Counter((lang, k) for lang, t in texts for k in quality.keys_of([t], e)[0].tolist())
    for held, step in ((3_000_000, 256), (4, 3)):
        monkeypatch.setattr(quality, "HELD", held)
        monkeypatch.setattr(quality, "TEXTS", step)
        got = Counter()
        for b in quality._counts(tokenizer_path(), 1000)(iter([batch, batch.slice(0, 0)])):
            for r in b.to_pylist():
                got[r["lang"], r["key"]] += r["c"]
        assert got == want


def test_labels_agree(spark):
    """Held-out accuracy against the labels; toxic text of good quality is not what a model of text rejects."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).toPandas().merge(labels.toPandas(), left_on="id", right_on="doc_id")
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.keep.mean() > 0.97 and bad.keep.mean() < 0.25


@pytest.mark.parametrize("name", ["edges", "clashing", "nothing"])
def test_awkward_rows(spark, request, name):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, None), (8, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(request.getfixturevalue(name), labels).collect()
    assert len(got) == (0 if name == "nothing" else 11)
    assert all(r["keep"] for r in got if r["tokens"] == 0)
    assert all(r["keep"] for r in quality.classify(request.getfixturevalue(name), labels.limit(0)).collect())


def test_the_driver_holds_the_model_in_parts(spark, monkeypatch):
    """No broadcast has more than one kind of entries of one language, and all are gone from the driver afterwards."""
    docs = [(i, f"some words {i % 7} of {'one' if i % 2 else 'another'} text", ["en", "de"][i % 2]) for i in range(40)]
    made, gone, model = [], [], []
    context = type(spark.sparkContext)
    broadcast, destroy, held = context.broadcast, quality.Broadcast.destroy, quality.held_tables
    monkeypatch.setattr(context, "broadcast", lambda self, value: made.append((value, b := broadcast(self, value))) or b)
    monkeypatch.setattr(quality.Broadcast, "destroy", lambda self, *a: gone.append(self) or destroy(self, *a))
    monkeypatch.setattr(quality, "held_tables", lambda entries: model.append(entries.groupBy("lang", "kind").count().collect()) or held(entries))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    texts, _ = quality.perplexities(df, df.selectExpr("doc_id", "1 quality", "0 toxic"))
    assert texts.where("perplexity > 0").count() == 40
    assert sorted(len(key) for (key, _), _ in made) == sorted(r["count"] for r in model[0]) and len(made) == 12
    assert {id(b) for _, b in made} == {id(b) for b in gone}


def test_the_driver_gives_memory_back(spark):
    from millrace.llm.common import give_back

    assert "Trim native heap" in give_back(spark)
