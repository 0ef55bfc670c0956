"""Token-id files: patched frame-of-reference blocks with an index of block starts.

Ids are written in ascending id order of their documents. A stored row is a chunk of whole documents: its payload holds
the document ids and lengths, the index of block starts, and the blocks. A block is ``BLOCK`` ids: the least id, the
differences packed at a width that a percentile of them fits, and a list of exceptions for the rest. Rows are written
by Spark's Parquet writer (one binary column, not compressed again), so a retried task leaves no second copy.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cipherfolio.llm import sharding
from cipherfolio.llm.word_tokens import END_ID, word_ids

BLOCK = 512
PERCENTILE = 0.9
CHUNK_IDS = 1 << 18
#: Bytes of text that one range aims at, the most ranges there are, and sample rows for each.
PART_BYTES, MOST_PARTS, SAMPLED = 1 << 22, 1 << 13, 8
MAGIC = b"PFR2"
HEAD = struct.Struct("<4sIQIII")  # magic, documents, ids, block size, blocks, documents without id (they come first)
BLOCK_HEAD = struct.Struct("<IHBx")  # least id, exceptions, width


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, 64 k) values below 2**width -> (rows, k * width) 64-bit words."""
    rows = values.reshape(-1, 64).T.astype(np.uint64)
    words = np.zeros((width, rows.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= rows[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= rows[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(len(values), -1)


def unpack_bits(words: np.ndarray, width: int, count: int) -> np.ndarray:
    """Back to (rows, count) values."""
    if not width:
        return np.zeros((len(words), count), np.uint64)
    columns = words.reshape(-1, width).T
    values = np.empty((64, columns.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        value = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | columns[word + 1] << np.uint64(64 - shift)
        values[i] = value & mask
    return np.ascontiguousarray(values.T).reshape(-1, count)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def write_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of an array of unsigned 32-bit ids; the last is filled up with its own least id."""
    if not len(ids):
        return []
    blocks = -(-len(ids) // BLOCK)
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    grid[len(ids) :] = ids[(blocks - 1) * BLOCK :].min()
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1)
    rest = grid - least[:, None]
    place = min(BLOCK - 1, int(percentile * BLOCK))
    widths = bit_lengths(np.partition(rest, place, axis=1)[:, place])
    odd_row, odd_at = np.nonzero(rest >= (np.uint64(1) << widths.astype(np.uint64))[:, None])
    odd_high = (rest[odd_row, odd_at].astype(np.uint64) >> widths[odd_row].astype(np.uint64)).astype(np.uint32)
    bounds = np.searchsorted(odd_row, np.arange(blocks + 1))
    packed: list[bytes] = [b""] * blocks
    for width in np.unique(widths):
        rows = np.nonzero(widths == width)[0]
        if width:
            words = pack_bits(rest[rows].astype(np.uint64) & np.uint64((1 << int(width)) - 1), int(width))
            for row, line in zip(rows, words, strict=True):
                packed[row] = line.tobytes()
    odd_at = odd_at.astype(np.uint16)
    return [
        BLOCK_HEAD.pack(int(least[b]), int(bounds[b + 1] - bounds[b]), int(widths[b])) + packed[b]
        + odd_at[bounds[b] : bounds[b + 1]].tobytes() + odd_high[bounds[b] : bounds[b + 1]].tobytes()
        for b in range(blocks)
    ]


def write_chunk(doc_ids: list[int], lengths: list[int], ids: np.ndarray, percentile: float = PERCENTILE, nulls: int = 0) -> bytes:
    blocks = write_blocks(ids, percentile)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.uint64)]).astype(np.uint64)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), BLOCK, len(blocks), nulls)
    return b"".join([head, np.asarray(doc_ids, np.int64).tobytes(), np.asarray(lengths, np.uint64).tobytes(), starts.tobytes(), *blocks])


class Chunk:
    """A payload opened for reading: all ids, or those from one position on through the index."""

    def __init__(self, payload: bytes) -> None:
        magic, documents, self.size, self.block, self.blocks, self.nulls = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a chunk of token blocks")
        at = HEAD.size
        self.doc_ids = np.frombuffer(payload, np.int64, documents, at)
        self.lengths = np.frombuffer(payload, np.uint64, documents, at + 8 * documents).astype(np.int64)
        self.starts = np.frombuffer(payload, np.uint64, self.blocks + 1, at + 16 * documents).astype(np.int64)
        self.payload, self.data = payload, at + 16 * documents + 8 * (self.blocks + 1)

    def read_blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first..last-1."""
        count = last - first
        out = np.empty((count, self.block), np.uint64)
        least, widths = np.empty(count, np.uint64), np.empty(count, np.int64)
        odd = []
        for b in range(count):
            at = self.data + int(self.starts[first + b])
            least[b], exceptions, widths[b] = BLOCK_HEAD.unpack_from(self.payload, at)
            if exceptions:
                tail = at + BLOCK_HEAD.size + int(widths[b]) * self.block // 8
                odd.append((b, np.frombuffer(self.payload, np.uint16, exceptions, tail), np.frombuffer(self.payload, np.uint32, exceptions, tail + 2 * exceptions)))
        for width in np.unique(widths):
            rows = np.nonzero(widths == width)[0]
            words = [np.frombuffer(self.payload, np.uint64, int(width) * self.block // 64, self.data + int(self.starts[first + b]) + BLOCK_HEAD.size) for b in rows]
            out[rows] = unpack_bits(np.stack(words), int(width), self.block)
        for b, places, high in odd:
            out[b, places] |= high.astype(np.uint64) << np.uint64(widths[b])
        return (out + least[:, None]).astype(np.uint32).reshape(-1)[: self.size - first * self.block]

    def ids(self) -> np.ndarray:
        return self.read_blocks(0, self.blocks) if self.blocks else np.empty(0, np.uint32)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1, reading only the blocks that hold them."""
        first = start // self.block
        return self.read_blocks(first, -(-stop // self.block))[start - first * self.block : stop - first * self.block] if stop > start else np.empty(0, np.uint32)


def placed_documents(docs: DataFrame, id_col: str, text_col: str, part_bytes: int) -> DataFrame:
    """Documents with the range they go to: ranges of about equal bytes in the order of (no id, id, hash of the text).

    Boundaries come from a size-weighted sample of slim keys. The lowest bits of a key are the row's own, so that one id,
    and even one row repeated, is cut like any other stretch.
    """
    least, key, text = -(1 << 63), F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.xxhash64(text).bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(0xFFFF)))
    rows = docs.select(
        key.isNotNull().alias("known"), F.coalesce(key, F.lit(0)).alias("doc_key"), F.coalesce(F.greatest(key, F.lit(least + 1)), F.lit(least)).alias("_group"),
        F.when(key == least, F.lit(least)).otherwise(hashed).alias("_tie"), F.lit(0).cast("long").alias("_row"), (F.octet_length(text).cast("long") + 1).alias("size"), text.alias("text"))
    keys = rows.select("_group", "_tie", "_row", "size")
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, min(MOST_PARTS, -(-total // part_bytes)))
    cuts = sharding.splitters(sharding.weighted_sample(keys, total, max(sharding.SAMPLE_ROWS, SAMPLED * ranges)), ranges)
    return sharding.with_range(rows, cuts).select(F.col("_range").cast("int").alias("part"), "known", "doc_key", "_tie", "text")


def narrow(ids: bytes) -> bytes:
    """Ids as 16-bit integers where all fit, led by their width; the form in which they are shuffled."""
    wide = np.frombuffer(ids, np.uint32)
    fits = not len(wide) or int(wide.max()) < 1 << 16
    return b"\x02" + wide.astype(np.uint16).tobytes() if fits else b"\x04" + ids


def widened(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids[1:], np.uint16 if ids[0] == 2 else np.uint32).astype(np.uint32)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk_ids: int = CHUNK_IDS, part_bytes: int = PART_BYTES) -> None:
    """Token files of all documents under ``path``: rows (part, chunk, documents, tokens, payload).

    Texts are encoded where they are read; what is shuffled are ids, to ranges that ascend in the document id, so
    (part, chunk) is the order of the ids. A chunk ends with the document that fills it; a longer document is a chunk of
    its own.

    Defined cases: a null or empty text is the end id alone. Null ids come first and are read back as null. Rows that repeat
    an id follow each other by a hash of their texts; equal rows, whose order no reader can see, may lie in several parts,
    so a repeated id is no single task's work. An empty table writes no chunk. Other columns are not read.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(vocabulary), END_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [narrow(encoder.ids(text.as_py()) + end) for text in some.column(4)]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), pa.array(ids, pa.binary())], ["part", "known", "doc_key", "_tie", "ids"])

    shape = "part int, known boolean, doc_key long, _tie long, ids binary"
    encoded = placed_documents(docs, id_col, text_col, part_bytes).mapInArrow(encode, shape)
    ordered = encoded.repartition("part").sortWithinPartitions("part", "known", "doc_key", "_tie")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, held, nulls = None, 0, 0, 0
        doc_ids, lengths, texts = [], [], []

        def flush() -> pa.RecordBatch:
            payload = write_chunk(doc_ids, lengths, np.concatenate(texts), nulls=nulls)
            return pa.RecordBatch.from_arrays(
                [pa.array([here], pa.int32()), pa.array([number], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())],
                ["part", "chunk", "documents", "tokens", "payload"])

        for batch in batches:
            for part, known, key, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), batch.column(4), strict=True):
                ids = widened(packed.as_py())
                if held and (part != here or held + len(ids) > chunk_ids):
                    yield flush()
                    number = number + 1 if part == here else 0
                    held, nulls = 0, 0
                    doc_ids, lengths, texts = [], [], []
                here = part
                doc_ids.append(key)
                nulls += not known
                lengths.append(len(ids))
                texts.append(ids)
                held += len(ids)
        if held:
            yield flush()

    stored = ordered.mapInArrow(chunks, "part int, chunk long, documents long, tokens long, payload binary")
    stored.write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """From the files alone: one row per document (part, chunk, id, local start, ``n_tokens``, ``ids``), and the start of each chunk.

    ``with_starts`` joins the two: a start counts the ids of all documents before. Chunk sizes are summed per part, and parts (one per written
    file) in order; payloads are decoded where they are read and never shuffled.
    """
    stored = spark.read.parquet(path)

    def open_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                chunk = Chunk(payload.as_py())
                ids, stops = chunk.ids(), np.cumsum(chunk.lengths)
                starts, n = stops - chunk.lengths, len(stops)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, number.as_py(), np.int64)), pa.array(chunk.doc_ids, mask=np.arange(n) < chunk.nulls), pa.array(starts), pa.array(chunk.lengths),
                     pa.array([ids[a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary())],
                    ["part", "chunk", id_col, "local_start", "n_tokens", "ids"])

    documents = stored.select("part", "chunk", "payload").mapInArrow(open_chunks, f"part int, chunk long, `{id_col}` long, local_start long, n_tokens long, ids binary")
    sizes = stored.select("part", "chunk", "tokens")
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("_in")).select("part", F.coalesce(F.sum("_in").over(before_part), F.lit(0)).alias("_part_start"))
    before = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "chunk", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("_chunk_start")).join(parts, "part")
    return documents, starts.select("part", "chunk", (F.col("_part_start") + F.col("_chunk_start")).alias("_start"))


def with_starts(documents: DataFrame, starts: DataFrame) -> DataFrame:
    """Local starts become global ones. Drop ``ids`` first if they are not needed: the join may shuffle these rows."""
    return documents.join(starts, ["part", "chunk"]).withColumn("start", F.col("_start") + F.col("local_start")).drop("part", "chunk", "local_start", "_start")
