"""Byte-level BPE by dynamic programming over prefixes, and decoding.

The exact encoding of every prefix of a piece ends in one token that no other prefix split allows. An automaton of all
tokens lists the tokens that end at each byte; of these the one stays whose pair with the last token of the prefix
before it is compatible, that is, BPE would leave the two side by side. Back-pointers from the end give the ids. Work
is linear in the bytes, also for one word of a million letters.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherfolio.llm.word_tokens import byte_letters

#: Fixed value of the vocabulary file's kind: how a text is split into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ODD_SPACE = regex.compile(r"\A\s|\s\Z|\s\s")
MOST_REMEMBERED = 300_000
LONGEST_REMEMBERED = 64
NEVER = 1 << 60


class PrefixBpe(dict):
    """Ids (little-endian unsigned 32-bit) of a word after a space, or after a newline if it begins with one."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        spelled = {bytes(byte_of[c] for c in token): number for token, number in described["model"]["vocab"].items() if all(c in byte_of for c in token)}
        self.special = {token["content"]: token["id"] for token in described["added_tokens"]}
        for content in self.special:
            spelled.pop(content.encode(), None)
        size = max([*spelled.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for content, number in [*spelled.items(), *((text.encode(), number) for text, number in self.special.items())]:
            self.bytes_of[number] = content
        self.names = [str(i) for i in range(size)]
        self.rank: dict[tuple[int, int], int] = {}
        self.made = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        for rank, (left, right) in enumerate(merge if isinstance(merge, list) else merge.split(" ") for merge in described["model"]["merges"]):
            a, b = (bytes(byte_of[c] for c in side) for side in (left, right))
            pair, whole = (spelled[a], spelled[b]), spelled[a + b]
            self.rank.setdefault(pair, rank)
            if self.parts[whole] is None:
                self.made[whole], self.parts[whole] = rank, pair
        self.known_pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[bytes, int] = {}
        for content, number in spelled.items():
            parts = self.parts[number]
            if parts is None and len(content) == 1 or parts and self.apart(*parts, self.made[number]):  # BPE does reach it
                self.automaton.add_word(content.decode("latin-1"), (number, len(content)))
                self.whole[content] = number
        self.automaton.make_automaton()
        self.pieces: dict[str, bytes] = {}
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def apart(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether BPE, merging by rank and from the left, keeps the two side by side for all ranks below ``until``.

        Played backwards: the latest merge at either edge is undone, and the pair seen in that state must not have been
        due before it. Of equal ranks the left merge comes first.
        """
        made, parts, rank = self.made, self.parts, self.rank
        while True:
            if rank.get((left, right), NEVER) < until:
                return False
            if made[left] > made[right]:
                until, left = made[left], parts[left][1]
            elif made[right] >= 0:
                until, right = made[right] + 1, parts[right][0]
            else:
                return True

    def piece(self, text: str) -> bytes:
        """Ids of one piece: last token of every prefix, then back from the end."""
        content = text.encode()
        one = self.whole.get(content)
        if one is not None:
            return array("I", [one]).tobytes()
        size, pairs = len(content), self.known_pairs
        last, before = [0] * (size + 1), [0] * (size + 1)
        found = 0
        for end, (token, length) in self.automaton.iter(content.decode("latin-1")):
            end += 1
            if end == found:
                continue
            start = end - length
            if start:
                pair = (last[start], token)
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.apart(*pair)
                if not fits:
                    continue
            last[end], before[end], found = token, start, end
        ids = []
        while size:
            ids.append(last[size])
            size = before[size]
        ids.reverse()
        return array("I", ids).tobytes()

    def remembered(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            known = self.piece(piece)
            if len(piece) <= LONGEST_REMEMBERED:
                self.pieces[piece] = known
        return known

    def split(self, text: str) -> bytes:
        return b"".join(map(self.remembered, PIECES.findall(text)))

    def __missing__(self, word: str) -> bytes:
        found = self.split(word if word[0] == "\n" else " " + word)
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = found
        return found

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. Where white space stands alone, words are looked up one by one."""
        if not text or ODD_SPACE.search(text):
            return self.split(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.split(first) + b"".join(map(self.__getitem__, rest))

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text; null is empty. Special tokens in it become their ids, as the library has it."""
        if not text:
            return b""
        for memory in (self, self.pieces, self.known_pairs):
            if len(memory) > MOST_REMEMBERED:
                memory.clear()
        if self.between is None or not self.between.search(text):
            return self.plain(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self.plain(x) for x in self.between.split(text))

    def decimal(self, ids: bytes) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.names.__getitem__, array("I", ids)))

    def text(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def prefix_bpe(path: str) -> PrefixBpe:
    """One vocabulary per worker process, kept for its later tasks."""
    return PrefixBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Id and ``ids`` (little-endian unsigned 32-bit) of every whole text, encoded where it is read.

    With ``decode`` also ``names`` (decimal ids joined by commas) and ``decoded`` (the text of the ids), made in the same
    worker: a task then holds one vocabulary and one set of memories.

    Defined cases: a null or empty text has no ids. Null and repeated ids are kept row by row. An empty table gives no
    rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_key"].dataType.simpleString()
    columns = ["doc_key", "ids", *(["names", "decoded"] if decode else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = prefix_bpe(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.ids(x.as_py()) for x in part.column(1)]
                made = [pa.array(ids, pa.binary())]
                if decode:
                    made += [pa.array([bpe.decimal(x) for x in ids], pa.string()), pa.array([bpe.text(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], columns)

    shape = f"doc_key {kind}, ids binary" + (", names string, decoded string" if decode else "")
    return rows.mapInArrow(encode, shape).withColumnRenamed("doc_key", id_col)


def decoded(ids: str, vocabulary: str) -> Column:
    """The text of an ``ids`` column; null ids give null."""

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        bpe = prefix_bpe(vocabulary)
        return column.map(lambda x: None if x is None else bpe.text(x))

    return decode(ids)
