"""Joining handshakes with the accessor events that follow them, in batch.

A completed handshake is held for a window per thread; what the thread reads
within it is attached, and a newer handshake replaces one still held. Events
are cut into slices one window long. A handshake is copied into its own and
the next slice, so every lookup stays inside (thread, slice): a thread with a
third of all events is spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

THREAD = ["host", "pid", "tid"]
READ = ("version", "cipher", "group")


def enrich_handshakes(events: DataFrame, window_us: int) -> tuple[DataFrame, DataFrame]:
    """``(handshakes, accessor events with what became of them)``.

    Events need event_id, host, pid, tid, ts_us, phase, retval and the three values
    (NULL where not read). Ties in time go by event_id.
    """
    completed = (F.col("phase") == "return") & (F.col("retval") == 1)
    sliced = events.withColumn("completed", F.coalesce(completed, F.lit(False))).withColumn("slice", F.floor(F.col("ts_us") / window_us))
    held = sliced.filter("completed")
    copies = held.withColumn("slice", F.explode(F.array(F.col("slice"), F.col("slice") + 1))).withColumn("own", F.floor(F.col("ts_us") / window_us) == F.col("slice"))
    reads = sliced.filter("phase = 'enrich'").withColumn("own", F.lit(True))
    order = Window.partitionBy(*THREAD, "slice").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last(F.when(F.col("completed"), F.struct("ts_us", "event_id", *READ)), ignorenulls=True).over(order)
    placed = copies.unionByName(reads).withColumn("before", previous).filter("own")
    in_time = F.col("before").isNotNull() & (F.col("ts_us") - F.col("before.ts_us") < window_us)
    placed = placed.withColumn("holder", F.when(in_time, F.col("before")))

    # Reads are folded per handshake in order; once all three values are known
    # the handshake has been emitted and later reads have nothing to attach to.
    mine = Window.partitionBy("holder.event_id").orderBy("ts_us", "event_id")
    earlier = mine.rowsBetween(Window.unboundedPreceding, -1)
    attached = placed.filter("NOT completed AND holder IS NOT NULL")

    def known(name: str, frame: WindowSpec) -> Column:
        return F.coalesce(F.last(F.when(F.col(name) != "", F.col(name)), ignorenulls=True).over(frame), F.when(F.col(f"holder.{name}") != "", F.col(f"holder.{name}")))

    full_before = F.lit(True)
    for name in READ:
        full_before = full_before & known(name, earlier).isNotNull()
    # Reads that arrive together with values already complete count as orphans;
    # a handshake that carried all three itself still waits for its first read.
    number = F.row_number().over(mine)
    judged = attached.withColumn("late", full_before & (number > 1))
    counted = judged.filter("NOT late")
    values = counted.groupBy(F.col("holder.event_id").alias("event_id")).agg(
        *[F.max(F.when(F.col(n) != "", F.struct("ts_us", F.col("event_id").alias("at"), F.col(n).alias("value")))).alias(f"last_{n}") for n in READ],
        F.count(F.lit(1)).alias("reads"))
    full = F.lit(True)
    merged = held.select("event_id", *THREAD, "ts_us", *READ).join(values, "event_id", "left")
    for name in READ:
        merged = merged.withColumn(name, F.coalesce(F.col(f"last_{name}.value"), F.when(F.col(name) != "", F.col(name))))
        full = full & F.col(name).isNotNull()
    # A handshake still held when the thread completes the next one is replaced.
    heirs = placed.filter("completed AND holder IS NOT NULL").select(
        F.col("holder.event_id").alias("event_id"), F.col("event_id").alias("heir_id"), F.col("ts_us").alias("heir_us"))
    finished = merged.join(heirs, "event_id", "left").withColumn("emitted_early", full & (F.coalesce("reads", F.lit(0)) > 0))
    status = (
        F.when(F.col("emitted_early"), F.lit("complete"))
        .when(F.col("heir_id").isNotNull(), F.lit("replaced"))
        .otherwise(F.lit("expired"))
    )
    handshakes = finished.select("event_id", *THREAD, "ts_us", *READ, F.coalesce("reads", F.lit(0)).alias("reads"), status.alias("status"))
    orphans = placed.filter("NOT completed AND holder IS NULL").select("event_id", "ts_us", F.lit("orphan").alias("fate"))
    fates = judged.select("event_id", "ts_us", F.when(F.col("late"), F.lit("orphan")).otherwise(F.lit("attached")).alias("fate")).unionByName(orphans)
    return handshakes, fates
