"""The encoder against the library."""

import numpy as np

from millrace.llm.tokens import Encoder, tokenizer_path


class Ids(bytes):
    """Ids that count how often they are looked at to tell whether they are there."""

    n = 0

    def __eq__(self, other):
        Ids.n += 1
        return bytes.__eq__(self, other)

    __hash__ = bytes.__hash__


def test_known_words_are_joined_without_a_look_at_each():
    e = Encoder(tokenizer_path())
    texts = ["some plain words, and words again.", None, "", " ", "a", "word ", " word", "über naïve\nwords 日本語", "two  spaces", "<|endoftext|> words", "new at the end: unseenword", "unheardof at the start and unseenword, unseenword"]
    want = [np.array(e.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(texts) == want and Encoder(tokenizer_path(), remembered=0).encode(texts) == want
    e.words = {w: Ids(i) for w, i in e.words.items()}
    assert e.encode(texts) == want and Ids.n == 0
    del e.words["plain"], e.words["unseenword"]
    assert e.encode(texts) == want


def test_words_are_known_wherever_a_line_ends(monkeypatch):
    """A line feed and marks are pieces of their own, so that words beside them are learned once, and give the library's ids."""
    e = Encoder(tokenizer_path())
    want = lambda texts: [np.array(x.ids, "<u4").tobytes() for x in e.library.encode_batch(texts, add_special_tokens=False)]
    first = ["one alpha beta\ngamma delta\nÜber.", "one alpha\n", "\none", "tab\tone\rtwo beta", "one\n\ntwo", "one \ntwo", "one\n two", "it's alpha's\n'tis", "\n", "a\n\tb", "one <|endoftext|>\nbeta"]
    assert e.encode(first) == want(first)
    asked = []
    monkeypatch.setattr(e, "_learn", lambda new, f=e._learn: (asked.extend(new), f(new))[1])
    again = ["one delta\ngamma alpha\ngamma beta\nÜber. beta", "gamma\ngamma beta\n"]
    assert e.encode(again) == want(again) and not asked
    monkeypatch.setattr(e, "_whole", lambda texts, f=e._whole: (asked.extend(texts), f(texts))[1])
    marked = ["one delta*** beta%%%\ngamma*** alpha%%%"]
    assert e.encode(marked) == want(marked)
    assert {x for x in asked if x.endswith(("*", "%"))} == {"delta***", "beta%%%", "\ngamma***", "alpha%%%", "***", "%%%"}


def test_white_space_beside_other_white_space_goes_to_the_library(monkeypatch):
    """Found in the words that are cut anyway; a text of known words is not read once more for it."""
    from millrace.llm import tokens

    texts = [a + x + b for x in (" \t", "\t ", "\n\t", "\r\n", "  ", "\t\t", "  ", " \n", "\n ", "\n\n", "\t", " ") for a, b in (("one two", "one two"), ("", "two"), ("two", ""), ("one", "two one"))]
    for remembered in (1000, 0):
        e = Encoder(tokenizer_path(), remembered=remembered)
        want = [np.array(x.ids, "<u4").tobytes() for x in e.library.encode_batch(texts, add_special_tokens=False)]
        assert e.encode(texts) == want and e.encode(texts) == want
    read = []

    class Seen:
        def search(self, text, run=tokens._RUN):
            read.append(text)
            return run.search(text)

    monkeypatch.setattr(tokens, "_RUN", Seen())
    e = Encoder(tokenizer_path())
    e.encode(["one two one\ntwo"] * 2)
    assert set(read) == {"one"}


def test_blocks_are_the_same_bits_in_few_operations():
    """Value r of a lane begins at bit r * width; against whole numbers of Python."""
    from millrace.llm.tokenfile import LANES, _pack, _unpack

    rng = np.random.default_rng(3)
    for width in range(1, 33):
        v = rng.integers(0, 1 << width, (3, 64, LANES), dtype=np.uint64)
        words = _pack(v, width)
        assert words.shape == (3, width, LANES) and (_unpack(words, width) == v).all()
        for k, lane in ((0, 0), (2, LANES - 1)):
            bits = sum(int(x) << width * r for r, x in enumerate(v[k, :, lane]))
            assert [int(x) for x in words[k, :, lane]] == [bits >> 64 * w & (1 << 64) - 1 for w in range(width)]
