"""Sharding by sampled splitters: shards of nearly equal bytes, equal texts side by side.

Records are ordered by (hash of the text, id, a hash of the row's place). A size-weighted sample gives quantile boundaries
of many small ranges; bytes are then counted exactly per range, ranges that the sample left overfull are subdivided by a
sample of their own, and ranges are dealt to shards in order. A boundary inside a group of equal texts is moved to the
group's edge, so the group stays whole, unless the group alone overfills a range: then the boundaries inside it stay and
subdivide it by id, and rows of one text and id by their places.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherfolio.operators.durable import durable
from cipherfolio.operators.inventory import number_within

#: Ranges counted exactly, and expected sample rows. Both are independent of the input's size; neither drops a record.
RANGES = 2048
SAMPLE_ROWS = 16384
ORDER_KEY = ["_group", "_tie", "_row"]
#: A counted range of more than so many times its share is subdivided, in at most so many passes.
OVERFULL, PASSES = 3, 3
Cut = tuple[int, int | None, int | None]


def weighted_sample(keys: DataFrame, total: int, expected: int) -> DataFrame:
    """Each key is drawn ``size / step`` times on average: whole parts surely, the rest by a hash of the key.

    The expected number of draws is ``expected`` whatever the table holds; a row drawn several times is one row.
    """
    step = max(total / expected, 1.0)
    chance = F.pmod(F.xxhash64(*ORDER_KEY, F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = F.floor(F.col("size") / F.lit(step) + chance)
    return keys.select(*ORDER_KEY, drawn.alias("_weight")).filter("_weight > 0")


def splitters(sample: DataFrame, ranges: int) -> list[Cut]:
    """Boundaries at equal sampled weight, as (group, id, row); None where a group, or an id in it, is not cut.

    The window sees the sample only, whose size is fixed; at most ``ranges`` rows come back.
    """
    upto = Window.orderBy(*ORDER_KEY).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    placed = sample.withColumns({"_upto": F.sum("_weight").over(upto), "_all": F.sum("_weight").over(everything)})
    step = F.floor(F.col("_upto") * ranges / (F.col("_all") + 1))
    before = F.floor((F.col("_upto") - F.col("_weight")) * ranges / (F.col("_all") + 1))
    found = [tuple(row) for row in placed.filter(step > before).select(*ORDER_KEY).distinct().collect()]
    return snapped(found)


def snapped(found: list[Cut]) -> list[Cut]:
    """Cuts in order, moved to the edge of an id or group that no other cut falls in."""
    groups, ties = Counter(cut[0] for cut in found), Counter(cut[:2] for cut in found)
    moved = {(g, t if groups[g] > 1 else None, r if groups[g] > 1 and ties[g, t] > 1 else None) for g, t, r in found}
    return sorted(moved, key=lambda cut: [(x is not None, x or 0) for x in cut])


def range_of(cuts: list[Cut]) -> tuple[Column, Column]:
    """Number of boundaries at or below the row's key, found in two levels of about the square root each."""
    width = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    least = -(1 << 63)
    shape = "array<array<struct<g:bigint,t:bigint,r:bigint>>>"
    rows = [[{"g": g, "t": least if t is None else t, "r": least if r is None else r} for g, t, r in block] for block in blocks]
    fine = F.from_json(F.lit(json.dumps(rows)), shape)
    heads = F.from_json(F.lit(json.dumps([[row[0] for row in rows]])), shape)[0]
    here = F.struct(F.col("_group").alias("g"), F.col("_tie").alias("t"), F.col("_row").alias("r"))
    block = F.size(F.filter(heads, lambda cut: cut <= here))
    within = F.size(F.filter(F.element_at(fine, F.greatest(F.col("_block"), F.lit(1))), lambda cut: cut <= here))
    return block, F.when(F.col("_block") == 0, 0).otherwise((F.col("_block") - 1) * width + within)


def with_range(keys: DataFrame, cuts: list[Cut]) -> DataFrame:
    if not cuts:
        return keys.withColumn("_range", F.lit(0))
    block, number = range_of(cuts)
    return keys.withColumn("_block", block).withColumn("_range", number).drop("_block")


def counted_cuts(keys: DataFrame, total: int, ranges: int, sample_rows: int) -> list[Cut]:
    """Boundaries of the sample, and more of them inside the ranges that an exact count shows to be overfull."""
    cuts = splitters(weighted_sample(keys, total, sample_rows), ranges)
    for _ in range(PASSES):
        ranged = with_range(keys, cuts)
        sizes = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.max("size").alias("_most"))
        heavy = [r for r in sizes.filter(F.col("_bytes") > OVERFULL * F.greatest(F.lit(total / max(ranges, 1)), F.col("_most"))).collect()]
        if not heavy:
            break
        weight = sum(r["_bytes"] for r in heavy)
        inside = ranged.filter(F.col("_range").isin([r["_range"] for r in heavy]))
        more = splitters(weighted_sample(inside, weight, sample_rows), max(2, round(weight * ranges / total)))
        fresh = [cut for cut in more if cut not in cuts]
        if not fresh:
            break
        cuts = sorted({*cuts, *fresh}, key=lambda cut: [(x is not None, x or 0) for x in cut])
    return cuts


def shard_of_ranges(sizes: DataFrame, shards: int, total: int) -> DataFrame:
    """Ranges in order to shards in order: a range goes where the middle of its bytes lies."""
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("_bytes").over(upto) - F.col("_bytes") / 2
    return sizes.select("_range", F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard"))


def shard_by_bytes(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``range``, ``shard`` and ``slot`` (gapless in the shard).

    Law: bytes. Sizes of shards differ by about one range (1/128 of a shard) plus a group of equal texts smaller than a
    range. Equal texts share a shard unless they are heavier than a range and a shard ends inside them.

    Defined cases: a null text weighs 1 and equals the empty text. A null id sorts first. Rows that repeat an id and
    text follow each other with slots of their own, and are cut where they overfill a range. A document larger than a shard fills one alone, and others may stay
    empty. An empty table gives no rows. Columns other than the two named are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = durable(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("_group"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_tie"), F.xxhash64(F.monotonically_increasing_id()).alias("_row")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranged = with_range(keys, counted_cuts(keys, total, ranges, sample_rows))
    sizes = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"))
    placed = ranged.join(shard_of_ranges(sizes, shards, total), "_range")
    numbered = number_within(placed, ["shard"], ORDER_KEY, "slot")
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", F.col("_range").alias("range"), "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", files_per_shard: int = 1) -> None:
    """The records of each shard under ``path/shard=N``, in slot order inside a file; a retried job overwrites itself."""
    where = placed.select(F.col(id_col).alias("_pid"), "shard", "slot")
    rows = docs.join(where, docs[id_col].eqNullSafe(where["_pid"])).drop("_pid")
    spread = rows.repartition("shard", F.pmod("slot", F.lit(files_per_shard))).sortWithinPartitions("shard", "slot")
    spread.write.mode("overwrite").partitionBy("shard").parquet(path)
