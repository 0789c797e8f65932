"""Ids of the word-BPE tokenizer through a bounded cache of words."""

from __future__ import annotations

import array
import functools
import re


@functools.cache
def byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def spelled(text: str) -> str:
    return text if text.isascii() and text.isalnum() else text.encode().decode("latin-1").translate(byte_letters())


#: Words of Latin letters up to U+017F, digits and ASCII signs but the apostrophe and "<": normal form C leaves them as they are, each letter's lower case is one letter.
_LATIN = "a-zA-ZÀ-ÖØ-öø-įı-ſ"
_SIMPLE = re.compile(rf"[{_LATIN}0-9!-&(-/:;=-@\[-`{{-~]+")
_PARTS = re.compile(rf"[{_LATIN}]+|[0-9]|[!-/:-@\[-`{{-~]+")


class WordIds(dict):
    """Word in UTF-8 -> little-endian unsigned 32-bit ids. max_words bounds the cache, which is emptied when full; words over 64 bytes are not kept.

    Simple words are cut and merged by the tokenizer's model directly; all others go through the whole library.
    """

    def __init__(self, path: str, max_words: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        self.merge = self.tokenizer.model.tokenize

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode()
        if word.isascii() and word.isalpha():
            ids = [t.id for t in self.merge(word.lower())]
        elif _SIMPLE.fullmatch(word):
            ids = [t.id for part in _PARTS.findall(word.lower()) for t in self.merge(spelled(part))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        out = array.array("I", ids).tobytes()
        if len(raw) <= 64:
            if len(self) >= self.max_words:
                self.clear()
            self[raw] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text. The tokenizer drops all white space and never looks across it, so they are those of its parts between ASCII white space."""
        return b"".join(map(self.__getitem__, text.encode().split()))


@functools.lru_cache(2)
def word_ids(path: str) -> WordIds:
    """One for each Python process: its words stay known from task to task."""
    return WordIds(path)
