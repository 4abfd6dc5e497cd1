"""Ids of a white-space-dropping BPE tokenizer, word by word.

Such a tokenizer never merges across white space, so a text's ids are those of
its words in a row. Each Python worker keeps the ids of words it has met and asks
the library only for new ones. Words of Latin letters, and runs of ASCII
punctuation behind them, are one pre-token each and need no normalisation but
lower case, so they go straight to the library's BPE model. All others go through
the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

#: Words kept per worker in each of two generations; the memory when full is about 200 MB.
KEPT_WORDS = 500_000

#: Letters and then ASCII punctuation: two tokens' worth that the pre-tokenizer separates anyway.
WITH_PUNCTUATION = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)").fullmatch


#: Below it every letter is its own canonical composition.
LATIN_END = "\u0250"

#: str.split() takes these for white space; the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The characters by which byte-level BPE writes bytes: printable ones stand for themselves, the rest follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


def split_words(text: str) -> list[str]:
    if text.isprintable() or not SEPARATORS.search(text):
        return text.split()
    return [w for w in re.split(r"[ \t-\r\x85\xa0]+", text) if w]


class Words(dict):
    """Ids of each word met, in two generations: words met again move to the young one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.letters = byte_letters()
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old_words.get(word)
        if ids is None:
            ids = self.learn(word)
        self[word] = ids
        return ids

    def learn(self, word: str) -> bytes:
        head, tail = word, ""
        if not word.isalpha() and (m := WITH_PUNCTUATION(word)):
            head, tail = m[1], m[2]
        low = head.lower()
        if low.isalpha() and max(low) < LATIN_END and max(head) < LATIN_END:
            return self.part(low) + self.part(tail) if tail else self.part(low)
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.old_parts.get(part)
            if ids is None:
                written = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.tokenize(written)]).tobytes()
            self.parts[part] = ids
        return ids

    def forget(self) -> None:
        for words in (self, self.parts, self.old_words, self.old_parts):
            words.clear()

    def age(self) -> None:
        if len(self) > KEPT_WORDS:
            self.old_words = dict(self)
            self.clear()
        if len(self.parts) > KEPT_WORDS:
            self.old_parts, self.parts = self.parts, {}


@lru_cache(maxsize=2)
def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """texts -> their ids, little-endian unsigned 32-bit; ``forget()`` empties the memory of words."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    words = Words(path)

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            out.append(b"".join(map(words.__getitem__, split_words(text or ""))))
            words.age()
        return out

    encode.forget = words.forget
    return encode
