"""Rows without an id, and ids that several texts share: every operator gives each row its due."""

import zlib
from collections import Counter

import pytest

from millrace.llm import mixing, packing, sharding, simhash, substrings, tokenfile

PASSAGE = " ".join(f"word{i}" for i in range(60))
DOCS = [(None, "a b c d", "x"), (None, "a b c d", "x"), (None, None, None), (7, "one two three four", "x"), (7, f"{PASSAGE} and more", "y"), (3, "", "y"), (None, f"before {PASSAGE}", "y"), (5, "a b c d", "x"), (None, "quite on its own here", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(3)


def test_token_file(spark, docs, tmp_path):
    """Null ids come first; the file holds every row's tokens without a gap."""
    tokenfile.write_tokens(docs, f"file://{tmp_path}/t")
    got = sorted(tokenfile.digests(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 5 + [3, 5, 7, 7]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]


def test_repeats(docs):
    """The shared passage goes from both rows, whatever their ids."""
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"] > 0) for r in substrings.remove_repeats(docs).collect())
    assert got == Counter((d, len((t or "").encode()), PASSAGE in (t or "")) for d, t, _ in DOCS)


def test_packing(docs):
    """Rows of one id, or of none, are packed one by one."""
    got = packing.pack(docs).collect()
    whole = Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0)
    assert sum(whole.values()) == len(DOCS) and Counter(d for d, _ in whole.elements()) == Counter(d for d, *_ in DOCS)
    assert sum(r["length"] for r in got) == sum(n * k for (_, n), k in whole.items())


def test_shards(docs):
    got = sharding.balanced_shards(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in DOCS)


def test_fingerprints(docs):
    """A null id counts only where nothing else is reached."""
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault((r["doc_id"], r["fingerprint"]), []).append(r["component_id"])
    of = {t: f for t in {t or "" for _, t, _ in DOCS} for f in [next(r["fingerprint"] for r in simhash.near_duplicates(docs.where(docs.text.eqNullSafe(t or None))).collect())] if t}
    assert got[None, of["a b c d"]] == [5, 5] and got[5, of["a b c d"]] == [5]
    assert got[None, "0" * 16] == [3] and got[3, "0" * 16] == [3]
    assert got[None, of["quite on its own here"]] == [None]
    assert got[7, of["one two three four"]] == [7]


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert Counter((r["id"], r["size"]) for r in got) == Counter((d, len((t or "").split())) for d, t, _ in DOCS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
