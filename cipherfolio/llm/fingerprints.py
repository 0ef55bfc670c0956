"""Document fingerprints: bottom-k sketches of shingle hashes. Columns and SQL functions only.

A sketch is the k least distinct 64-bit hashes of a text's word shingles, ascending. Sketches of parts merge into the
sketch of the whole, and two sketches estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherfolio.operators.durable import durable
from cipherfolio.operators.inventory import number_within

WORDS = 5
SKETCH = 128
#: Width of a hash in hexadecimal digits.
DIGITS = 16


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of ``words`` words (split at white space). A shorter text is one shingle; one without words
    (null, empty, white space) has none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    hashed = F.transform(parts, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(1))), lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(words)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(many)

    return F.element_at(F.transform(F.array(hashed), runs), 1)


def least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, words: int = WORDS, k: int = SKETCH) -> Column:
    return least(shingle_hashes(text, words), k)


def merge(left: Column, right: Column, k: int = SKETCH) -> Column:
    """The sketch of both texts' shingles together."""
    return least(F.concat(left, right), k)


def merge_groups(sketches: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = SKETCH) -> DataFrame:
    """One sketch per key. Hashes are made distinct and ranked in two steps, so a hot key is spread over many tasks."""
    hashes = sketches.select(*keys, F.explode(sketch_col).alias("_hash")).groupBy(*keys, "_hash").agg(F.lit(1).alias("_one"))
    parted = hashes.withColumn("_part", F.pmod(F.xxhash64("_hash"), F.lit(64)))
    partial = parted.groupBy(*keys, "_part").agg(F.collect_list("_hash").alias("_hashes")).select(*keys, least(F.col("_hashes"), k).alias("_least"))
    return partial.groupBy(*keys).agg(least(F.flatten(F.collect_list("_least")), k).alias(sketch_col))


def resemblance(left: Column, right: Column, k: int = SKETCH) -> Column:
    """Estimated share of common shingles among all of both: 0 to 1. Exact while both texts fit their sketches.
    Two texts without shingles resemble each other fully."""
    common = F.size(F.array_intersect(merge(left, right, k), F.array_intersect(left, right)))
    most = F.size(merge(left, right, k))
    return F.when(most == 0, F.lit(1.0)).otherwise(common / most)


def distinct_shingles(hashes: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    reach = (F.element_at(hashes, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(hashes) < k, F.size(hashes).cast("double")).otherwise((k - 1) / reach)


def containment(left: Column, right: Column, k: int = SKETCH) -> Column:
    """Estimated share of the left text's shingles that the right one has. Nothing is fully contained in anything."""
    same = resemblance(left, right, k)
    shared = same / (1 + same) * (distinct_shingles(left, k) + distinct_shingles(right, k))
    return F.when(F.size(left) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(left, k)))


def as_text(hashes: Column) -> Column:
    """A sketch as fixed-width hexadecimal digits."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, k: int = SKETCH) -> DataFrame:
    """Id, text, ``n_chars``, ``sketch`` and ``shingles`` (estimated) of every whole text, where it is read.

    Defined cases: a null text is empty; a text without words has an empty sketch. Null and repeated ids are kept row
    by row. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), sketch(text, words, k).alias("sketch"))
    return rows.withColumn("shingles", distinct_shingles(F.col("sketch"), k))


def next_in_descending_order(rows: DataFrame, id_col: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """The row's id and ``ties``, and those of its follower as ``next_*``: the next smaller one, and for the least one the
    largest. Nulls come last. Only these columns move.

    Rows must differ in them; ``ties`` order rows of one id.
    """
    columns = [id_col, *ties]
    slim = rows.select(*columns).withColumn("_all", F.lit(0))
    ranked = durable(number_within(slim, ["_all"], columns, "_rank").select(*columns, "_rank"))
    last = ranked.agg(F.max("_rank")).first()[0]
    named = [F.col(c).alias("next_id" if c == id_col else f"next_{c}") for c in columns]
    after = ranked.select(*named, F.when(F.col("_rank") == F.lit(last), 0).otherwise(F.col("_rank") + 1).alias("_rank"))
    return ranked.join(after, "_rank").drop("_rank")
