"""Ids of a lower-casing word-end BPE vocabulary, one text at a time, equal to the tokenizers library's own.

The library spends most of its time on normalising and merging words it has met before. Its pieces never cross white
space, so a task splits a text at spaces and newlines and remembers the ids of each word and of each piece of a word.
Merging itself is the library's model. The memory is a bounded cache: when full it starts anew, and no text is cut.
"""

from __future__ import annotations

import unicodedata
from array import array
from functools import lru_cache

import regex

#: Fixed value of the vocabulary file: how it splits normalised text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
END_ID = 1
MOST_REMEMBERED = 600_000
LONGEST_REMEMBERED = 64


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else the next letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.pieces: dict[str, bytes] = {}

    def whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        spelled = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        found = self.pieces[text] = array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()
        return found

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST_REMEMBERED:
            return self.whole(word)
        if "<|" in word or "Σ" in word or not word.isprintable():  # special tokens, a letter lowered by context, odd spaces
            found = self.whole(word)
        else:
            plain = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
            known = self.pieces.get
            found = b"".join([known(x) or self.piece(x) for x in PIECES.findall(plain)])
        self[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text; null is empty."""
        if not text:
            return b""
        for memory in (self, self.pieces):
            if len(memory) > MOST_REMEMBERED:
                memory.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One vocabulary per worker process, kept for its later tasks."""
    return WordIds(path)
