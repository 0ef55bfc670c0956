"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Read without knowing what follows, bytes leave several ways open: every place where a token may have ended, with the
tokens before it, and a partial token since. A state of the transducer is this set of open ways. A byte moves all ways at
once; ways that no token continues die, a way may end in a token only where BPE would leave that token beside
the one before it, and tokens that all ways share are emitted. A way lives no longer than the longest token, so the
lookahead is bounded. States and moves are made when a text first needs them and remembered.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of memories (states, moves, pieces): when one is full it starts anew, and no text is cut.
MOST_STATES, MOST_PIECES, LONGEST_PIECE = 300_000, 600_000, 64
NEVER = 1 << 60
START = 0
BATCH = 256

Way = tuple[int, int, tuple[int, ...]]  # node of the partial token, last whole token (or -1), tokens not yet emitted


class Transducer(dict):
    """Merges of a rank file, compiled. As a dictionary it remembers the ids of pieces it has met."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        reached = [self.ranks[bytes([b])] for b in range(256)]
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and self._compile(token, rank):
                reached.append(rank)
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        inner: set[int] = set()
        for rank in reached:
            node = 0
            for b in self.bytes_of[rank]:
                inner.add(node)
                node = self.child.setdefault(node << 8 | b, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self.inner = bytearray(len(self.token_at))
        for node in inner:
            self.inner[node] = 1
        self.pairs: dict[tuple[int, int], bool] = {}
        self._forget()

    def _compile(self, token: bytes, rank: int) -> bool:
        """Find the two tokens whose merge makes this one; a token that merging never reaches has none."""
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut], NEVER), self.ranks.get(token[cut:], NEVER)
            if left < rank and right < rank and self._reached(left) and self._reached(right) and self._stays(left, right, rank):
                self.halves[rank], self.joined[left, right] = (left, right), rank
                return True
        return False

    def _reached(self, rank: int) -> bool:
        return rank in self.halves or len(self.bytes_of[rank]) == 1

    def _stays(self, left: int, right: int, until: int) -> bool:
        """Whether merging in order of rank, leftmost first, leaves the two side by side before ``until``.

        Undone backwards: of the two edge tokens the one merged later is taken apart, and the seam seen then must not have
        been due by that time. Single bytes were never merged.
        """
        halves, due = self.halves, self.joined.get
        while due((left, right), NEVER) >= until:
            left_made, right_made = left if left in halves else -1, right if right in halves else -1
            if left_made < 0 and right_made < 0:
                return True
            if left_made > right_made:
                left, until = halves[left][1], left_made
            else:  # equal ranks merge from the left, so a seam of the right one's rank came first
                right, until = halves[right][0], right_made + 1
        return False

    def fits(self, before: int, token: int) -> bool:
        """Whether the token may follow another; anything may come first."""
        if len(self.pairs) > MOST_PIECES:
            self.pairs.clear()
        known = self.pairs[before, token] = before < 0 or self._stays(before, token, NEVER)
        return known

    def _forget(self) -> None:
        self.states: list[tuple[Way, ...]] = []
        self.number: dict[tuple[Way, ...], int] = {}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._state(((0, -1, ()),))

    def _state(self, ways: tuple[Way, ...]) -> int:
        known = self.number.setdefault(ways, len(self.states))
        if known == len(self.states):
            self.states.append(ways)
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after one more byte and the tokens that are certain now; made once, then remembered."""
        child, token_at, inner, pairs = self.child.get, self.token_at, self.inner, self.pairs
        ways, ended = [], None
        for node, before, waiting in self.states[state]:
            node = child(node << 8 | byte)
            if node is None:
                continue
            token = token_at[node]
            if token >= 0 and ended is None:
                fits = pairs.get((before, token))
                if self.fits(before, token) if fits is None else fits:
                    ended = (0, token, (*waiting, token))
            if inner[node]:
                ways.append((node, before, waiting))
        tokens = ended[2]
        shared = len(tokens)
        for _, _, waiting in ways:
            shared = min(shared, len(waiting))
            while waiting[:shared] != tokens[:shared]:
                shared -= 1
        ways.append(ended)
        sure = tokens[:shared]
        if sure:
            ways = [(node, before, waiting[shared:]) for node, before, waiting in ways]
        if len(self.states) >= MOST_STATES or len(self.moves) >= 4 * MOST_STATES:
            self._forget()
            return self._state(tuple(ways)), sure
        move = self.moves[state << 8 | byte] = (self._state(tuple(ways)), sure)
        return move

    def run(self, content: bytes) -> list[int]:
        """Ids of one piece; each is written as soon as it is certain."""
        state, out, known = START, [], self.moves.get
        for byte in content:
            move = known(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
                known = self.moves.get
            state, sure = move
            if sure:
                out += sure
        out += self.states[state][-1][2]
        return out

    def __missing__(self, piece: str) -> bytes:
        content = piece.encode()
        whole = self.ranks.get(content)
        found = array("I", self.run(content) if whole is None else [whole]).tobytes()
        if len(piece) <= LONGEST_PIECE:
            self[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, little-endian unsigned 32-bit; every match of the pattern by itself. Null is empty."""
        if not text:
            return b""
        if len(self) > MOST_PIECES:
            self.clear()
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))


class Utf8Stream:
    """Characters out of bytes that come in any cuts: a state machine that holds an unfinished character back.

    A state is how many bytes are missing and between which bounds the next one lies. Broken sequences give U+FFFD, one
    for each longest beginning of a character.
    """

    #: Fixed values of UTF-8: first and last lead byte, bytes that follow, bounds of the first of these.
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF),
             (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))

    def __init__(self) -> None:
        self.lead = {b: (missing, low, high) for first, last, missing, low, high in self.LEADS for b in range(first, last + 1)}

    def step(self, held: bytes, content: bytes) -> tuple[str, bytes]:
        """Text that is complete after ``content``, and the bytes still held back; ``held`` is what the step before held."""
        if not held and content.isascii():
            return content.decode("ascii"), b""
        out, kept, (missing, low, high) = [], bytearray(), (0, 0, 0)
        for byte in held + content:
            if missing:
                if low <= byte <= high:
                    kept.append(byte)
                    missing, low, high = missing - 1, 0x80, 0xBF
                    if not missing:
                        out.append(kept.decode())
                        kept.clear()
                    continue
                out.append("�")
                kept.clear()
                missing = 0
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self.lead:
                kept.append(byte)
                missing, low, high = self.lead[byte]
            else:
                out.append("�")
        return "".join(out), bytes(kept)


class StreamDecoder:
    """Text of ids in pieces: a token's move from held bytes to text and held bytes is remembered."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of, self.machine = bytes_of, Utf8Stream()
        self.whole: dict[int, str] = {}
        for token, content in bytes_of.items():
            text, held = self.machine.step(b"", content)
            if not held and "�" not in text:
                self.whole[token] = text

    def feed(self, ids: Iterable[int], held: bytes = b"") -> tuple[str, bytes]:
        """Complete text of more ids after the bytes held back before, and what is held back now."""
        out = []
        whole, step, bytes_of = self.whole, self.machine.step, self.bytes_of
        for token in ids:
            text = None if held else whole.get(token)
            if text is None:
                text, held = step(held, bytes_of[token])
            out.append(text)
        return "".join(out), held

    def text(self, ids: bytes) -> str:
        """The text of all ids; an unfinished character at the end is broken."""
        text, held = self.feed(array("I", ids))
        return text + "�" if held else text

    def content(self, ids: bytes) -> bytes:
        """The exact bytes of all ids; text and bytes differ only where these are no UTF-8."""
        text = self.text(ids)
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))) if "�" in text else text.encode()


@lru_cache(maxsize=2)
def transducer(path: str, pattern: str) -> Transducer:
    """One transducer per worker process, kept with its states for later tasks.

    States are many small tuples without cycles, so the worker's collector of cycles is called less often.
    """
    gc.set_threshold(200_000, 50, 50)
    return Transducer(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str, pattern: str) -> StreamDecoder:
    return StreamDecoder(transducer(path, pattern).bytes_of)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Id and ``ids`` (little-endian unsigned 32-bit) of every whole text, and with ``decode`` the bytes decoded from them.

    Both happen in the task that reads the text, in one Python worker with one vocabulary; nothing is shuffled.

    Defined cases: a null or empty text has no ids and decodes to no bytes. Null and repeated ids are kept row by row. An
    empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("text"))
    names = ["doc_key", "ids", "decoded"][: 3 if decode else 2]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path, pattern)
        back = decoder(path, pattern).content if decode else None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                ids = [machine.encode(x.as_py()) for x in part.column(1)]
                columns = [part.column(0), pa.array(ids, pa.binary())] + ([pa.array(map(back, ids), pa.binary())] if decode else [])
                yield pa.RecordBatch.from_arrays(columns, names=names)

    shape = f"doc_key {rows.schema['doc_key'].dataType.simpleString()}, ids binary" + (", decoded binary" if decode else "")
    return rows.mapInArrow(encode, shape).withColumnRenamed("doc_key", id_col)


def decode_documents(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and ``text`` of every row of ids, decoded as a stream; null ids give null."""
    slim = rows.select(F.col(id_col).alias("doc_key"), F.col(ids_col).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = decoder(path, pattern).text
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [None if x is None else text(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_key", "text"])

    return slim.mapInArrow(decode, f"doc_key {slim.schema['doc_key'].dataType.simpleString()}, text string").withColumnRenamed("doc_key", id_col)
