"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, a document the average of all n-gram vectors of its words, so a misspelling
that was never seen shares most of its vectors with the word it hides. Embeddings and softmax are fitted together by
Adam on a bounded sample of labelled rows. Scores are linear in the n-grams, so a task needs one number per bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherfolio.llm.subwords import BUCKETS, WordCounts, bare, grams_of, words_of
from cipherfolio.llm.worker_memory import giving_back

#: Documented bound of the training sample: rows of each class, drawn by a hash of the id.
ROWS_PER_CLASS = 1500
DIMENSIONS = 4
EPOCHS = 70
RATE = 0.02
#: An n-gram seen in fewer sample documents has a zero vector: it would only learn its documents by heart.
LEAST_DOCUMENTS = 8
#: Weight of the toxic class in the loss, about twice its share: a missed one costs more than a clean one held back.
TOXIC_WEIGHT = 0.2
SPREAD = 10.0
SEED = 20
#: Texts whose words share one dictionary while they are scored.
TOGETHER = 1024
#: Sample texts whose entries are worked on together while the model is fitted, so that no array covers the whole sample's entries.
FITTED_TOGETHER = 128


@dataclass(frozen=True)
class Model:
    """Score of each bucket (difference of the two classes' logits) and the bias."""

    weights: np.ndarray
    bias: float


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> list[tuple[str, int]]:
    """Whole texts and labels of at most ``per_class`` rows of each class; rows held out are never drawn."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_label"))
    usable = known.filter(~held_out("_key")).dropDuplicates(["_key"])
    drawn = None
    for label in (0, 1):
        part = usable.filter(F.col("_label") == label).orderBy(F.xxhash64("_key"), "_key").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    # One row of each drawn id reaches the driver, however often the id repeats.
    text = F.coalesce(F.col(text_col), F.lit(""))
    met = docs.select(F.col(id_col).alias("_key"), F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("_row")).join(F.broadcast(drawn), "_key")
    rows = met.groupBy("_key", "_label").agg(F.min("_row").alias("_row")).orderBy("_key").select("_row.text", "_label").collect()
    return [(row[0], row[1]) for row in rows]


def bags(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (document, bucket, share of the document's n-grams), one per distinct pair, built document by document."""
    documents, found, shares = [], [], []
    for i, text in enumerate(texts):
        counts = Counter(map(bare, words_of(text)))
        if not counts:
            continue
        word_of, grams = grams_of(list(counts), buckets)
        times = np.fromiter(counts.values(), np.float64, len(counts))[word_of]
        bucket, where = np.unique(grams, return_inverse=True)
        documents.append(np.full(len(bucket), i, np.int32))
        found.append(bucket.astype(np.int32))
        shares.append((np.bincount(where, times) / times.sum()).astype(np.float32))
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32)
    return np.concatenate(documents), np.concatenate(found), np.concatenate(shares)


def fit(sample: list[tuple[str, int]], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS) -> Model:
    """Adam on embeddings, softmax and bias together, over the whole sample at each step, part by part.

    Sums over parts are made entry by entry in the order of the sample, so the parts do not change the model. The first
    dimension starts at the n-gram's smoothed log odds of the classes, the others near zero. With one class or none, the
    model says that class's share everywhere.
    """
    labels = np.array([label for _, label in sample], np.int64)
    toxic, clean = int(labels.sum()), int(len(labels) - labels.sum())
    flat = Model(np.zeros(buckets), float(np.log((toxic + 1) / (clean + 1)) if toxic + clean and not (toxic and clean) else 0.0))
    if not toxic or not clean:
        return flat
    starts = range(0, len(sample), FITTED_TOGETHER)
    parts = [bags([text for text, _ in sample[start : start + FITTED_TOGETHER]], buckets) for start in starts]
    held = np.zeros(buckets, np.int64)
    for _, bucket_at, _ in parts:
        held += np.bincount(bucket_at, minlength=buckets)
    enough = held >= LEAST_DOCUMENTS
    used = np.nonzero(enough)[0]
    if not len(used):
        return flat
    number = np.cumsum(enough, dtype=np.int32) - 1
    in_toxic, in_clean = np.zeros(len(used)), np.zeros(len(used))
    for i, (start, (doc_at, bucket_at, share)) in enumerate(zip(starts, parts, strict=True)):
        common = enough[bucket_at]
        doc_at, gram_at = doc_at[common].astype(np.int16), number[bucket_at[common]]
        parts[i] = doc_at, gram_at, share[common]
        in_toxic += np.bincount(gram_at, labels[start + doc_at], len(used))
        in_clean += np.bincount(gram_at, 1 - labels[start + doc_at], len(used))
    chance = np.random.default_rng(SEED)
    vectors = chance.standard_normal((len(used), dimensions)).astype(np.float32) * 0.01
    vectors[:, 0] = np.log((in_toxic + 1) / (toxic + 2)) - np.log((in_clean + 1) / (clean + 2))
    softmax = chance.standard_normal((dimensions, 2)).astype(np.float32) * 0.1
    softmax[0] = [-5, 5]
    bias = np.zeros(2, np.float32)
    weight = np.where(labels == 1, TOXIC_WEIGHT / toxic, (1 - TOXIC_WEIGHT) / clean)[:, None]
    parameters = [vectors, softmax, bias]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]

    def averaged() -> np.ndarray:
        bag = np.zeros((len(labels), dimensions), np.float32)
        for start, (doc_at, gram_at, share) in zip(starts, parts, strict=True):
            own = bag[start : start + FITTED_TOGETHER]
            for d in range(dimensions):
                own[:, d] = np.bincount(doc_at, vectors[gram_at, d] * share, len(own))
        return SPREAD * bag

    def slopes_of_grams(back: np.ndarray) -> np.ndarray:
        slopes = np.zeros((dimensions, len(used)))
        for start, (doc_at, gram_at, share) in zip(starts, parts, strict=True):
            own = back[start : start + FITTED_TOGETHER]
            for d in range(dimensions):
                np.add.at(slopes[d], gram_at, own[doc_at, d] * share)
        return slopes.T

    bag = averaged()
    middle = float(np.median(bag @ (softmax[:, 1] - softmax[:, 0])))
    bias[:] = [middle / 2, -middle / 2]
    for epoch in range(1, epochs + 1):
        logits = bag @ softmax + bias
        wrong = np.exp(logits - logits.max(axis=1, keepdims=True))
        wrong /= wrong.sum(axis=1, keepdims=True)
        wrong[np.arange(len(labels)), labels] -= 1
        wrong = wrong * weight
        back = SPREAD * (wrong @ softmax.T)
        slopes = [slopes_of_grams(back), bag.T @ wrong, wrong.sum(axis=0)]
        for p, m, v, slope, rate in zip(parameters, first, second, slopes, (RATE, 5 * RATE, 5 * RATE), strict=True):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            size = np.sqrt(v / (1 - 0.999**epoch))
            p -= (rate * (m / (1 - 0.9**epoch)) / (np.maximum(size, 0.01 * size.max()) + 1e-12)).astype(np.float32)
        bag = averaged()
    weights = np.zeros(buckets)
    weights[used] = SPREAD * (vectors @ (softmax[:, 1] - softmax[:, 0]))
    return Model(weights, float(bias[1] - bias[0]))


def mean_scores(texts: Iterable[str | None], weights: np.ndarray) -> np.ndarray:
    """The mean weight of all n-grams of each text."""
    counts = WordCounts.of(map(words_of, texts))
    return counts.mean_weights(weights[None], list(map(bare, counts.words)))[:, 0]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Id, the columns of ``keep``, and ``score``: the softmax probability of label 1 for every whole text.

    Scored where it is read; the model, one number per bucket, is broadcast (2 MB, whatever the input).

    Defined cases: a null or empty text, or one without words, gets the bias alone. Null and repeated ids are scored row
    by row. An empty table gives no rows. Columns not named are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    place: dict[str, int] = {}  # a text that is scored and kept travels once
    for c in (text_col, id_col, *keep):
        place.setdefault(c, len(place))
    rows = docs.select(*(F.col(c).alias(f"sent_{i}") for c, i in place.items()))
    back, names = [place[c] for c in (id_col, *keep)], ["doc_key", *(f"kept_{i}" for i in range(len(keep)))]
    kinds = ", ".join(f"{name} {rows.schema.fields[i].dataType.simpleString()}" for name, i in zip(names, back, strict=True))

    @giving_back
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                out = 1 / (1 + np.exp(-np.clip(bias + mean_scores((x.as_py() for x in part.column(0)), weights), -50, 50)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in back), pa.array(out, pa.float64())], [*names, "score"])

    scored = rows.mapInArrow(score, f"{kinds}, score double")
    return scored.select(F.col("doc_key").alias(id_col), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "score")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = ROWS_PER_CLASS) -> Model:
    """The model of a bounded sample. Inputs are texts alone: no id, language or source.

    Defined cases: labels that are null or whose id is null or not among ``docs`` are not used; of labels that repeat an
    id one is. Without usable labels every document scores one half.
    """
    return fit(training_sample(docs, labels, id_col, text_col, label_col, per_class))
