"""Vector codes of 16 parts, with codebooks refined in integers over Hilbert-sorted blocks.

Vectors become integers and are cut into parts. A task sorts the parts of its vectors along a Hilbert curve and cuts
them into flat blocks of neighbours with a box (least and greatest component) and a sum. In every round the distances
from a box to an entry, nearest and farthest, leave each block a short list of entries that can be nearest; one entry
left means the whole block is assigned by its sum, more are decided by exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherfolio.operators.durable import durable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 32
#: A chunk of vectors that is sorted and kept together holds about so many components.
CHUNK_COMPONENTS = 1 << 22
#: Components beyond this are refused: squared distances of whole vectors would not fit 64 bits.
LARGEST = 1 << 23
SALTS = 16


def hilbert_key(points: np.ndarray) -> np.ndarray:
    """Place of each point (n x dimensions) along a Hilbert curve through the box of all points."""
    n, dimensions = points.shape
    used = min(dimensions, 62)
    bits = max(1, min(10, 62 // used))
    low = points.min(axis=0)[:used]
    width = np.maximum(points.max(axis=0)[:used] - low + 1, 1)
    x = ((points[:, :used] - low) * (1 << bits) // width).T.copy()
    # From the highest bit down: where a coordinate has the bit, the first one is flipped below it, else both trade low bits.
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for i in range(used):
            has = (x[i] >> bit) & 1 == 1
            trade = np.where(has, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(has, x[0] ^ below, x[0] ^ trade)
            x[i] ^= trade
    for i in range(1, used):
        x[i] ^= x[i - 1]
    flips = np.zeros(n, np.int64)
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where((x[used - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flips
    key = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(used):
            key = key << 1 | (x[i] >> bit) & 1
    return key


class Blocks:
    """One part of a chunk's vectors in Hilbert order: flat blocks with boxes and sums."""

    def __init__(self, order: np.ndarray, points: np.ndarray) -> None:
        self.order, self.points = order, points
        self.starts = np.arange(0, len(points), BLOCK)
        self.low, self.high = np.minimum.reduceat(points, self.starts), np.maximum.reduceat(points, self.starts)
        self.sums = np.add.reduceat(points, self.starts)
        self.sizes = np.diff(np.append(self.starts, len(points)))

    def short_lists(self, entries: np.ndarray) -> np.ndarray:
        """Blocks x entries: whether an entry can be nearest to some point of the block, ties included."""
        low, high, e = self.low[:, None], self.high[:, None], entries[None]
        nearest = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(-1)
        farthest = (np.maximum(np.abs(e - low), np.abs(e - high)) ** 2).sum(-1)
        return nearest <= farthest.min(axis=1, keepdims=True)

    def assign(self, entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of every point in block order; adds the points to ``sums`` and ``counts``."""
        codes, errors = np.empty(len(self.points), np.int64), np.empty(len(self.points), np.int64)
        possible = self.short_lists(entries)
        alone = possible.sum(axis=1) == 1
        first = possible.argmax(axis=1)
        np.add.at(sums, first[alone], self.sums[alone])
        np.add.at(counts, first[alone], self.sizes[alone])
        for b, start in enumerate(self.starts):
            stop = start + self.sizes[b]
            points = self.points[start:stop]
            if alone[b]:
                codes[start:stop] = first[b]
                errors[start:stop] = ((points - entries[first[b]]) ** 2).sum(-1)
                continue
            listed = np.nonzero(possible[b])[0]
            distances = ((points[:, None] - entries[listed][None]) ** 2).sum(-1)
            at = distances.argmin(axis=1)  # the first of equal ones has the lower index
            codes[start:stop], errors[start:stop] = listed[at], distances[np.arange(len(at)), at]
            np.add.at(sums, listed[at], points)
            np.add.at(counts, listed[at], 1)
        return codes, errors


def sorted_chunks(rows: DataFrame, dimension: int) -> DataFrame:
    """Rows (vec_id, label, vector) -> rows of chunks: ids, labels, and per part the Hilbert order and sorted integers."""
    width, most = dimension // PARTS, max(BLOCK, CHUNK_COMPONENTS // dimension)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def chunk(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(tables).combine_chunks()
        values = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False) for b in tables]).astype(np.float64)
        scaled = np.floor(values.reshape(-1, dimension) * SCALE)
        if np.abs(scaled).max(initial=0) > LARGEST:
            raise ValueError(f"a component times {SCALE} lies beyond {LARGEST}; scale the vectors first")
        scaled = scaled.astype(np.int64)
        orders, points = [], []
        for part in range(PARTS):
            mine = scaled[:, part * width : (part + 1) * width]
            order = np.argsort(hilbert_key(mine), kind="stable")
            orders.append(order.astype("<i4"))
            points.append(mine[order].astype("<i4"))
        columns = [pa.array([whole.column(i).to_pylist()], pa.list_(whole.schema.field(i).type)) for i in (0, 1)]
        blobs = [pa.array([np.stack(x).tobytes()], pa.binary()) for x in (orders, points)]
        return pa.RecordBatch.from_arrays([*columns, *blobs], names=["vec_ids", "labels", "orders", "points"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if size + part.num_rows > most:
                    yield chunk(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield chunk(held)

    return rows.mapInArrow(chunks, f"vec_ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, orders binary, points binary")


def blocks_of(row: dict, width: int) -> Iterator[Blocks]:
    n = len(row["vec_ids"])
    orders = np.frombuffer(row["orders"], "<i4").reshape(PARTS, n)
    points = np.frombuffer(row["points"], "<i4").reshape(PARTS, n, width).astype(np.int64)
    return (Blocks(orders[p], points[p]) for p in range(PARTS))


def refined(chunks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks (parts x entries x width) after one round over all chunks: floored means, unused entries as they were."""
    parts, entries, width = codebooks.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for part, blocks in enumerate(blocks_of(row, width)):
                    blocks.assign(codebooks[part], sums[part], counts[part])
        part, entry = np.nonzero(counts)
        place = ((part * entries + entry)[:, None] * width + np.arange(width)).ravel()
        columns = [pa.array(x, pa.int64()) for x in (place, sums[part, entry].ravel(), np.repeat(counts[part, entry], width))]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "total", "n"])

    rows = chunks.mapInArrow(add, "place long, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    new = codebooks.copy().ravel()
    for place, total, n in rows:
        new[place] = total // n
    return new.reshape(codebooks.shape)


def encoded(chunks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code (one byte a part), error of every vector under the codebooks."""
    width = codebooks.shape[2]
    kinds = {f.name: f.dataType.elementType.simpleString() for f in chunks.schema.fields[:2]}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                lists = [batch.column(i).slice(at, 1).flatten() for i in (0, 1)]
                row = {"vec_ids": lists[0], "orders": batch.column(2)[at].as_py(), "points": batch.column(3)[at].as_py()}
                codes, errors = np.empty((len(lists[0]), PARTS), np.uint8), np.zeros(len(lists[0]), np.int64)
                for part, blocks in enumerate(blocks_of(row, width)):
                    ignored = np.zeros(codebooks.shape[1:], np.int64), np.zeros(codebooks.shape[1], np.int64)
                    found, far = blocks.assign(codebooks[part], *ignored)
                    codes[blocks.order, part] = found
                    errors[blocks.order] += far
                yield pa.RecordBatch.from_arrays([*lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], names=["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(encode, f"vec_id {kinds['vec_ids']}, label {kinds['labels']}, code binary, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error, label_error; the codebooks)``.

    Nothing is shuffled but sums of codebook entries and of errors: a task sorts what it reads, so chunks differ with the
    partitions, results do not. The driver holds the codebooks (64 entries of one vector's size), never vectors beyond
    the 64 first ones. A label's rows meet its sum in 16 parts, so a hot label is not one task.

    Defined cases: vectors that are null, hold null or non-finite components, or whose length is no positive multiple
    of 16 or another one than that of the least id are dropped. Fewer than 64 rows give fewer entries. Ids sort with nulls last and
    repeated ids by their vectors. Null labels form one group. An empty table gives no rows. Components beyond 2^15 raise an error.
    Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0) & ~odd)
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    least = whole.orderBy(*order).limit(1).collect()
    dimension = len(least[0].vector) if least else PARTS
    kept = whole.filter(F.size("vector") == dimension)
    first = kept.orderBy(*order).limit(ENTRIES).collect()
    width = dimension // PARTS
    start = np.floor(np.array([r.vector for r in first], np.float64).reshape(len(first), dimension) * SCALE).astype(np.int64)
    codebooks = np.ascontiguousarray(start.reshape(len(first), PARTS, width).transpose(1, 0, 2))
    chunks = durable(sorted_chunks(kept, dimension))
    for _ in range(ROUNDS if first else 0):
        codebooks = refined(chunks, codebooks)
    coded = durable(encoded(chunks, codebooks))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    spread = sums.select("label_error", F.col("label").alias("_label"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    met = salted.join(spread, F.col("label").eqNullSafe(F.col("_label")) & (salted["_salt"] == spread["_salt"]))
    return met.select("vec_id", "label", "code", "error", "label_error"), codebooks


def code_text(code: str) -> Column:
    """Codes as two lower-case hex digits a part."""
    return F.lower(F.hex(code))


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
