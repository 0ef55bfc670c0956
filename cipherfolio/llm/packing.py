"""Packing by powers of two: a document is cut into pieces of binary lengths, equal lengths share a bucket.

A document of n tokens is n // limit pieces of ``limit`` tokens and then one piece for each binary digit of the rest,
longest first. A piece is a sequence: none holds two documents and none is padded. A loader reads one bucket per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherfolio.llm.word_tokens import END_ID, word_ids
from cipherfolio.operators.inventory import number_within

SEQUENCE_TOKENS = 2048
BATCH_ROWS = 256


def binary_lengths(tokens: int, limit: int = SEQUENCE_TOKENS) -> list[int]:
    """Lengths of the pieces of a document, longest first. ``limit`` is a power of two."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError(f"{limit} is not a power of two")
    rest = tokens % limit
    return [limit] * (tokens // limit) + [1 << bit for bit in range(limit.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``.

    No shuffle: each document is cut where it is read. Batches are small, and a piece is at most ``limit`` ids, so
    a very long document is many small rows.

    Defined cases: a null or empty text is the end id alone (one piece of one token). Null and repeated ids are kept,
    each row cut on its own. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(vocabulary), END_ID.to_bytes(4, "little")
        for batch in batches:
            keys = batch.column(0)
            for at in range(0, batch.num_rows, BATCH_ROWS):
                took, starts, lengths, pieces, totals = [], [], [], [], []
                for i, text in enumerate(batch.column(1).slice(at, BATCH_ROWS).to_pylist(), at):
                    ids = encoder.ids(text) + end
                    start, total = 0, len(ids) // 4
                    for length in binary_lengths(total, limit):
                        took.append(i)
                        starts.append(start)
                        lengths.append(length)
                        totals.append(total)
                        pieces.append(ids[4 * start : 4 * (start + length)])
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(took, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(pieces, pa.binary()), pa.array(totals, pa.int64())],
                    ["doc_key", "start", "length", "ids", "doc_tokens"])

    pieces = rows.mapInArrow(cut, f"doc_key {kind}, start long, length long, ids binary, doc_tokens long")
    return pieces.withColumnRenamed("doc_key", id_col)


def number_sequences(pieces: DataFrame, id_col: str = "doc_id", limit: int = SEQUENCE_TOKENS) -> DataFrame:
    """Adds ``bucket`` (log2 of the length), ``bucket_slot`` (gapless in the bucket), ``sequence_id`` and ``offset``.

    A bucket may hold a third of all pieces: it is numbered over many tasks. Keep ``ids`` out of ``pieces`` here;
    the numbers meet them again by (id, start).
    """
    buckets = limit.bit_length()
    bucketed = pieces.withColumn("bucket", F.round(F.log2("length")).cast("int"))
    numbered = number_within(bucketed, ["bucket"], [id_col, "start"], "bucket_slot")
    return numbered.withColumns({"sequence_id": F.col("bucket_slot") * buckets + F.col("bucket"), "offset": F.lit(0).cast("long")})
