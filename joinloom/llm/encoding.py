"""Exact token ids at the speed of a dictionary: the library merges each distinct word once.

Both vocabularies here split a text into words before any merge, and a merge never crosses a word, so the
ids of a text are the ids of its words in order. Texts outside the plain range, where two
libraries might see characters differently, and texts with special strings go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Plain: tab, line feed, carriage return, printable ASCII, and what follows it up to U+017F but for
#: the soft hyphen, white space other than ASCII's, and the two letters whose lower case is two letters long.
_PLAIN = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x130), *range(0x132, 0x180))]


def _ranges(chars: list[str]) -> str:
    """Characters as the inside of a character class."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in out)


_L, _N = (_ranges([c for c in _PLAIN if unicodedata.category(c)[0] == kind]) for kind in "LN")
_ODD = re.compile(f"[^{_ranges(_PLAIN)}]")
#: The splitting patterns of the two public vocabularies, as their files give them, over plain characters.
_BYTE_WORDS = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")
_LOWER_WORDS = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^\\s{_L}{_N}]+")


def _byte_letters() -> str:
    """The letter for each byte in byte-level vocabularies: itself if visible in Latin-1, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return "".join(chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256))


_BYTES = _byte_letters()


class Encoder:
    """``ids(text)``: little-endian unsigned 32-bit ids of a text, as ``encode(text, add_special_tokens=False)`` has them."""

    def __init__(self, path: str, most_words: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merge = self.library.model.tokenize
        self.lower = bool(self.library.normalizer)
        self.words = _LOWER_WORDS if self.lower else _BYTE_WORDS
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Words met lately and words met before those; together at most ``most_words``.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most_words = most_words

    def split(self, text: str) -> list[str] | None:
        """Words of a plain text, else None."""
        if _ODD.search(text) or any(s in text for s in self.special):
            return None
        return self.words.findall(text.lower() if self.lower else text)

    def ids(self, text: str) -> bytes:
        words = self.split(text)
        if words is None or len(words) > self.most_words:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if 2 * len(self.known) > self.most_words:
                self.known, self.older = {}, self.known
            self.learn(words)
            return b"".join(map(self.known.__getitem__, words))

    def learn(self, words: list[str]) -> None:
        known, older, merge = self.known, self.older, self.merge
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    letters = w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(_BYTES)
                    known[w] = b"".join([t.id.to_bytes(4, "little") for t in merge(letters)])


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)
