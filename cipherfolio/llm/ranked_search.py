"""Ranked lexical search as dense matrix products: tiles of items times tiles of documents.

A document's impact for a term is an integer, and so is its score: the sum of impacts times how often the item holds
the term. Items are cut into tiles with a small vocabulary of their own; documents into tiles of impacts over that
vocabulary. Their product in float64 is exact, because every partial sum stays below 2^53; longer sums are cut into
slices that do, and added as 64-bit integers. Every task keeps the best documents of each item, ties by id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherfolio.operators.durable import durable

#: Letters and digits of ASCII, lower-cased, and all bytes beyond ASCII make up terms; the rest separates them.
LOWERED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Documented bound: so many terms of items (repeats included) are searched for in one pass over the documents.
PASS_TERMS = 1 << 18
TILE_DOCUMENTS, TILE_ITEMS, TILE_TERMS = 512, 64, 4096
#: Exactness: a slice's sums stay below twice this, and the sums of a tile's slices fit 64 bits.
SLICE = 1 << 50
TILE = "ids binary, nulls binary, lengths binary, ends binary, terms binary, counts binary"
KEPT = "item_no int, doc_id long, score long, task int"


def terms_of(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(LOWERED).split()


def document_tiles(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Rows of up to 512 documents: ids, numbers of terms, and how often each holds terms of the vocabulary."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCUMENTS):
                part = batch.slice(at, TILE_DOCUMENTS)
                lengths, ends, terms, counts = [], [], [], []
                for text in part.column(1):
                    words = terms_of(text.as_py())
                    lengths.append(len(words))
                    for word, count in Counter(words).items():
                        known = number(word)
                        if known is not None:
                            terms.append(known)
                            counts.append(count)
                    ends.append(len(terms))
                ids = part.column(0)
                nulls = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.bool_)
                columns = [ids.fill_null(0).to_numpy(), nulls, *(np.array(x, kind) for x, kind in ((lengths, "<i8"), (ends, "<i8"), (terms, "<i4"), (counts, "<i4")))]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=[c.split()[0] for c in TILE.split(", ")])

    return docs.mapInArrow(tiles, TILE)


class Tile:
    """One row of ``document_tiles`` as arrays."""

    def __init__(self, row: dict[str, bytes]) -> None:
        self.ids, self.nulls = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], np.bool_)
        self.lengths, ends = np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["ends"], "<i8")
        self.terms, self.counts = np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["counts"], "<i4").astype(np.int64)
        self.of = np.repeat(np.arange(len(self.ids)), np.diff(ends, prepend=0))

    def impacts(self, weights: np.ndarray, documents: int, terms: int) -> np.ndarray:
        """The integer impact of each held term."""
        longest = int(self.lengths.max(initial=0))
        if 75 * longest * documents < 1 << 63:
            share = 75 * self.lengths * documents // max(terms, 1)
        else:
            share = np.array([75 * int(n) * documents // terms for n in self.lengths], np.int64)
        m = (100 - 75 + share)[self.of]
        return weights[self.terms] * (1_000_000_000 * self.counts // (1000 * self.counts + 8 * m))


def corpus_counts(tiles: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and documents per vocabulary term, summed over all tiles."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, terms = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                tile = Tile(row)
                documents, terms = documents + int((tile.lengths > 0).sum()), terms + int(tile.lengths.sum())
                held += np.bincount(tile.terms, minlength=size)
        some = np.nonzero(held)[0]
        names, numbers = np.concatenate([[-2, -1], some]), np.concatenate([[documents, terms], held[some]])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(numbers, pa.int64())], names=["term", "n"])

    sums = dict(tiles.mapInArrow(add, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(i, 0) for i in range(size)], np.int64)


def term_weight(documents: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


def exact_slices(counts: np.ndarray, ceilings: np.ndarray) -> list[np.ndarray]:
    """Matrices (terms x items) that add up to ``counts``; with impacts up to ``ceilings`` a product of one stays below 2^53."""
    most = np.maximum(SLICE // np.maximum(ceilings, 1), 1)[:, None]
    found = []
    while counts.any():
        part = np.minimum(counts, most)
        counts = counts - part
        number = np.cumsum(part * ceilings[:, None], axis=0) // SLICE
        found += [np.where(number == n, part, 0).astype(np.float64) for n in range(int(number.max()) + 1)]
    return found


class ItemTile:
    """Up to 64 items over a slice of at most 4,096 of their terms."""

    def __init__(self, items: list[int], terms: list[int], held: list[Counter], weights: np.ndarray) -> None:
        self.items, self.terms = np.array(items), np.array(terms, np.int64)
        counts = np.array([[held[i][t] for i in items] for t in terms], np.int64).reshape(len(terms), len(items))
        self.slices = exact_slices(counts, weights[self.terms] * 1_000_000)

    def scores(self, tile: Tile, impacts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Exact scores, documents x items; ``place`` is scratch over the whole vocabulary."""
        place[:] = -1
        place[self.terms] = np.arange(len(self.terms))
        at = place[tile.terms]
        mine = at >= 0
        dense = np.zeros((len(tile.ids), len(self.terms)))
        dense[tile.of[mine], at[mine]] = impacts[mine]
        total = np.zeros((len(tile.ids), len(self.items)), np.int64)
        for part in self.slices:
            total += (dense @ part).astype(np.int64)
        return total


def item_tiles(held: list[Counter], weights: np.ndarray) -> list[list[ItemTile]]:
    """Tiles of all items, grouped by items: what a group's tiles give is added up."""
    groups = []
    for at in range(0, len(held), TILE_ITEMS):
        items = list(range(at, min(at + TILE_ITEMS, len(held))))
        terms = sorted(set().union(*(held[i] for i in items)))
        groups.append([ItemTile(items, terms[a : a + TILE_TERMS], held, weights) for a in range(0, len(terms), TILE_TERMS)])
    return groups


class Best:
    """The best documents of each item so far: highest score, then least id, null ids last."""

    def __init__(self, best: int) -> None:
        self.best = best
        self.rows = np.zeros((0, 4), np.int64)  # item, score, null, id
        self.least: dict[int, int] = {}

    def offer(self, items: np.ndarray, scores: np.ndarray, tile: Tile) -> None:
        floors = np.array([self.least.get(int(i), 1) for i in items])
        document, item = np.nonzero(scores >= floors)  # an equal score may win by its id
        if not len(document):
            return
        new = np.stack([items[item], scores[document, item], tile.nulls[document], tile.ids[document]], axis=1)
        mine = np.isin(self.rows[:, 0], items)
        rows = np.concatenate([self.rows[mine], new])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        starts = np.searchsorted(rows[:, 0], rows[:, 0])
        rank = np.arange(len(rows)) - starts
        rows = rows[rank < self.best]
        full = rank[rank < self.best] == self.best - 1
        self.least |= dict(zip(rows[full, 0].tolist(), rows[full, 1].tolist()))
        self.rows = np.concatenate([self.rows[~mine], rows])


def best_of_tiles(tiles: DataFrame, held: list[Counter], weights: np.ndarray, documents: int, terms: int, best: int) -> DataFrame:
    """The best documents of every item within each task's tiles."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        groups, place, kept = item_tiles(held, weights), np.zeros(len(weights), np.int64), Best(best)
        for batch in batches:
            for row in batch.to_pylist():
                tile = Tile(row)
                impacts = tile.impacts(weights, documents, terms)
                for group in groups:
                    if group:
                        scores = sum(t.scores(tile, impacts, place) for t in group)
                        kept.offer(group[0].items, scores, tile)
        item, score, null, number = kept.rows.T
        ids = pa.array(number, pa.int64(), mask=null.astype(bool))
        task = np.full(len(item), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(score, pa.int64()), pa.array(task, pa.int32())], names=[c.split()[0] for c in KEPT.split(", ")])

    return tiles.mapInArrow(search, KEPT)


def rank_documents(docs: DataFrame, items: DataFrame, best: int = 10, pass_terms: int = PASS_TERMS, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the highest-scoring documents of every item, equal scores by ascending id.

    Items are searched for in passes of about ``pass_terms`` terms; a pass reads all documents once, whatever their
    number, and only a pass's items and vocabulary reach the driver and the tasks. N, L and document counts are taken over
    all documents. Each task returns at most ``best`` rows an item; these are ranked in two steps, so that no task
    ranks the rows of all tasks.

    Defined cases: null and empty texts have no terms; they count for nothing and are never returned. Items without
    terms have no rows. Every row of a table is a document or an item of its own: repeated ids are ranked row by row, null
    ids after all others. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL")
    size = asked.select(F.sum(F.size(F.split(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    passes = max(1, math.ceil(size / pass_terms))
    found = None
    for number in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).collect()
        vocabulary: dict[bytes, int] = {}
        held = [Counter(vocabulary.setdefault(w, len(vocabulary)) for w in terms_of(r.text.encode())) for r in rows]
        if not vocabulary and found is not None:
            continue
        tiles = durable(document_tiles(texts, vocabulary))
        documents, terms, counts = corpus_counts(tiles, len(vocabulary))
        weights = np.array([term_weight(documents, int(n)) for n in counts], np.int64)
        local = best_of_tiles(tiles, held, weights, documents, terms, best)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        parts = Window.partitionBy("item_no", F.col("task") % 64).orderBy(*order)
        few = local.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= best)
        whole = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_no").orderBy(*order))).filter(F.col("rank") <= best)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item_no int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        ranked = whole.join(names, "item_no").select("item_id", "rank", "doc_id", "score")
        found = ranked if found is None else found.unionByName(ranked)
    return found
