"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Columns and SQL functions only. A first scan leaves one slim row per document (id, byte length, hash of the first
bytes). Documents alone in their length, and then alone in (length, prefix hash), are settled there. Only what is left
has its whole content hashed, in a second scan that meets the survivors by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherfolio.operators.durable import durable

PREFIX_CHARS = 256
WHITESPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text that is compared: white-space runs are one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def survivors(keys: DataFrame) -> DataFrame:
    """Rows of (_id, _bytes, _prefix) that are not alone after each refinement.

    Each step counts with map-side sums, so a group holding a third of all rows is a few partial counts, and meets the
    rows again by an equality join that adaptive execution may split.
    """
    lengths = keys.groupBy("_bytes").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_bytes")
    level = keys.join(lengths, "_bytes", "left_semi")
    prefixes = level.groupBy("_bytes", "_prefix").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return level.join(prefixes, ["_bytes", "_prefix"], "left_semi")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_rest: bool = False) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and ``full_hash`` (32 bytes of SHA-256).

    Of equal normalised texts the smallest id stays. ``full_hash`` is null for a row settled before its content was
    read, unless ``hash_rest``.

    Defined cases: a null text is the empty text. Rows that repeat an id and its text count one by one in
    ``group_size``; one of them stays. A row with a null id stays only if no copy has an id (then one of the null rows
    stays). An empty table gives no rows. Other columns are never read, so their names cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    shape = rows.withColumns({"_bytes": F.octet_length("_norm"), "_prefix": F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS))})
    keys = durable(shape.drop("_norm"))
    open_keys = survivors(keys).select("_id", "_bytes", "_prefix").distinct().select(
        F.col("_id").alias("_sid"), F.col("_bytes").alias("_sbytes"), F.col("_prefix").alias("_sprefix"), F.lit(True).alias("_open"))
    met = shape.join(open_keys, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_bytes") == F.col("_sbytes")) & (F.col("_prefix") == F.col("_sprefix")), "left")
    is_open = F.coalesce(F.col("_open"), F.lit(False))
    full = F.unhex(F.sha2("_norm", 256))
    hashed = durable(met.select("_id", is_open.alias("_open"), (full if hash_rest else F.when(is_open, full)).alias("_full")))

    alone = hashed.filter(~F.col("_open")).select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_full").alias("full_hash"))
    folded = hashed.filter("_open").groupBy("_full", "_id").agg(F.count(F.lit(1)).alias("_times"))
    groups = folded.groupBy("_full").agg(F.min("_id").alias("keep_id"), F.sum("_times").alias("group_size"))
    decided = (
        folded.join(groups, "_full").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
        .select(
            F.col("_id").alias(id_col), "keep_id", "group_size",
            (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), F.col("_full").alias("full_hash"))
    )
    return alone.unionByName(decided)
