"""Texts to token ids with a public byte-level tokenizer, words remembered."""

from __future__ import annotations

import os
import re
import string
from functools import cache

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
#: Words a Python worker remembers; later ones are encoded each time they come.
REMEMBERED = 1_000_000
#: Texts whose words are held at once; those of few stay in a processor's cache.
TOGETHER = 16
#: A run of white space is cut differently by the tokenizer than at each space; texts that have one, or words that may be beside one, go to it whole.
_RUN = re.compile(r"\s\s|^[^\S\n]|\s\Z")
#: Marks behind a word that are one piece of their own, whichever they are.
_TAIL = string.punctuation
#: Byte-level vocabularies write a byte that is no visible Latin-1 character as one from 256 on, in order.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizer gives them.

    The tokenizer cuts every text where a space follows a character that is not
    white space, and encodes the pieces one by one.  So a word with the space
    before it has the same ids wherever it stands, and is encoded once.  A line
    feed is a piece of its own where no other white space is beside it; a word
    behind one is kept with it, as it has no space.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.remembered = remembered
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)  # tokens that end a sentence or a line
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith((".", "!", "?", "Ċ"))
        self.packed = [i.to_bytes(4, "little") for i in range(self.size)]
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.feed = self._whole(["\n"])[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of ``new`` words, each with a space before it, or with the line feed that it begins with; none of those with ``_RUN``."""
        out, rest, known, packed, tokenize = {}, [], self.words, self.packed, self.library.model.tokenize
        for w in new:
            stem = w.rstrip(_TAIL)
            feed = stem[:1] == "\n"
            letters = stem[1:] if feed else stem
            if not letters.isalpha():
                if not _RUN.search(w):
                    rest.append(w)
                continue
            # A space and letters are one piece, or letters behind a line feed, and the marks after them another.
            ids = known.get(stem) or out.get(stem)
            if ids is None:
                piece = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTES)
                ids = b"".join([packed[t.id] for t in tokenize(piece if feed else "Ġ" + piece)])
                out[stem] = ids = self.feed + ids if feed else ids
            if len(stem) < len(w):
                tail = w[len(stem) :]
                marks = self.tails.get(tail)
                if marks is None:
                    marks = self._whole([tail])[0]
                    if len(self.tails) < self.remembered:
                        self.tails[tail] = marks
                out[w] = ids + marks
        out.update(zip(rest, self._whole([w if w[:1] == "\n" else " " + w for w in rest])))
        if len(known) < self.remembered:
            known.update(out)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; null is taken as empty."""
        return [ids for lo in range(0, len(texts), TOGETHER) for ids in self._together(texts[lo : lo + TOGETHER])]

    def _together(self, texts: list[str | None]) -> list[bytes]:
        known = self.words.get
        heads: list[str] = []
        wholes: list[str] = []
        # Of each text its ids behind the first word, None if it goes whole; or its words, their ids as far as they are known, and where they are not.
        found: list[bytes | None | tuple[list[str], list[bytes | None], list[int]]] = []
        new: set[str] = set()
        for t in texts:
            if not t:
                heads.append("")
                found.append(b"")
                continue
            words = t.replace("\n", " \n").split(" ")
            # Spaces and line feeds beside each other show here, other white space in the words themselves.
            if "" in words or "\n" in words or "<|" in t or _RUN.search(words[0]):
                wholes.append(t)
                found.append(None)
                continue
            ids = list(map(known, words))
            ids[0] = b""
            heads.append(words[0])
            try:
                found.append(b"".join(ids))
            except TypeError:  # some are None; this tells sooner than a look at each
                missing = [k for k, i in enumerate(ids) if i is None]
                new.update([words[k] for k in missing])
                found.append((words, ids, missing))
        fresh = self._learn(new).get if new else None
        head = iter(self._whole(heads))
        whole = iter(self._whole(wholes))
        out = []
        for t, x in zip(texts, found):
            if x is None:
                out.append(next(whole))
            elif isinstance(x, bytes):
                out.append(next(head) + x)
            else:
                words, ids, missing = x
                for k in missing:
                    ids[k] = fresh(words[k])
                ids[0] = next(head)
                try:
                    out.append(b"".join(ids))
                except TypeError:  # a word that has no ids of its own
                    out += self._whole([t])
        return out


@cache
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder for each Python worker, kept over its tasks."""
    return Encoder(path, remembered)
