"""Structured Streaming jobs over the event spool: ingestion, enrichment, findings, counters.

All work on rows is the batch library's Column code, run on what a micro-batch adds; no row passes through Python. What a
job must remember between micro-batches is a table in its folder, one directory per micro-batch, so a batch that is run
again after a failure finds the state it started from and replaces what it wrote.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from cipherfolio.operators import enrich
from cipherfolio.sources import spool

EVENT = ["event_id", *enrich.THREAD, "ts_us", "phase", "retval", *enrich.READ]
#: Before all and after all event times.
NEVER, ALWAYS = -(1 << 60), 1 << 60


class Observed(StreamingQueryListener):
    """Sums of the metrics that running streams report with ``observe``, by name of observation and metric."""

    def __init__(self) -> None:
        self.totals: dict[str, Counter] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.totals.setdefault(name, Counter()).update(row.asDict())

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass


def _started(writer: object, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest(lines: DataFrame, good_path: str, reject_path: str, checkpoint: str, available_now: bool = True, max_bytes: int | None = None) -> StreamingQuery:
    """Split rows of the spool to accepted events and a dead-letter table.

    The checkpoint makes each file count once. Every micro-batch owns one directory per table and overwrites it. Its lines
    are read and parsed once and kept until both tables are written. ``ingest`` is observed: ``seen`` counts all lines that are not
    blank before anything is decoded, ``bytes`` what they hold.
    """
    blank = F.trim("line") == ""
    counted = lines.observe("ingest", F.count_if(~blank).alias("seen"), F.sum(F.when(~blank, F.octet_length("line")).otherwise(F.lit(0))).alias("bytes"))

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        judged = spool.judge_lines(spool.number_lines(kept), max_bytes).persist()
        good, bad = spool.split_lines(judged)
        spool.parse_events(good).write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")
        judged.unpersist()
        kept.unpersist()

    return _started(counted.writeStream.foreachBatch(write), checkpoint, available_now)


def append_findings(events: DataFrame, path: str, checkpoint: str, host: str = "localhost", available_now: bool = True) -> StreamingQuery:
    """Observed findings of a stream of events, appended exactly once."""
    found = spool.event_findings(events, F.lit(host))
    return _started(found.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, available_now)


# --- enrichment -------------------------------------------------------------

def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _closed_before(spark: SparkSession, folder: str, batch: int) -> tuple[int | None, int]:
    """The last micro-batch before this one and the event time below which it decided everything."""
    if not _exists(spark, f"{folder}/closed"):
        return None, NEVER
    last = spark.read.schema("closed_us long, batch int").parquet(f"{folder}/closed").filter(F.col("batch") < batch).orderBy(F.col("batch").desc()).first()
    return (None, NEVER) if last is None else (last.batch, last.closed_us)


def _decide(spark: SparkSession, folder: str, batch: int, open_events: DataFrame, before: int, closed: int, window_us: int) -> None:
    """What became of all events in [before, closed), and of handshakes whose window ended by then.

    A read looks back one window at most and a handshake ahead one, so the open events that reach back one window before
    ``before`` are all that any of these depend on.
    """
    handshakes, fates = enrich.enrich_handshakes(open_events.filter(F.col("ts_us") < closed), window_us)
    ended = handshakes.filter((F.col("ts_us") >= before - window_us) & (F.col("ts_us") < closed - window_us))
    settled = fates.filter((F.col("ts_us") >= before) & (F.col("ts_us") < closed))
    completed = F.coalesce((F.col("phase") == "return") & (F.col("retval") == 1), F.lit(False))
    passed = open_events.filter(~completed & ~F.coalesce(F.col("phase") == "enrich", F.lit(False)) & (F.col("ts_us") >= before) & (F.col("ts_us") < closed))
    through = passed.select("event_id", *enrich.THREAD, "ts_us", *enrich.READ, F.lit(0).cast("bigint").alias("reads"), F.lit("passed").alias("status"))
    ended.unionByName(through).write.mode("overwrite").parquet(f"{folder}/emitted/batch={batch}")
    settled.write.mode("overwrite").parquet(f"{folder}/fates/batch={batch}")
    # Last, so that it marks the batch as done.
    spark.createDataFrame([(closed,)], "closed_us long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/closed/batch={batch}")


def enrich_stream(events: DataFrame, folder: str, checkpoint: str, window_us: int, late_us: int = 0, available_now: bool = True) -> StreamingQuery:
    """The streaming form of ``enrich_handshakes``, equal to it on the same events.

    Event time is cut into slices one window long. The watermark is the latest event time less ``late_us``; a slice that it
    has passed is closed and decided once, by the batch rules, which split a thread over its slices. State are the events
    from one window before the watermark's slice on; older ones leave it as the watermark moves. An event of a closed
    slice (or without time) changes nothing any more: its fate is ``late``. ``emitted``, ``fates`` read the results, ``flush``
    ends the run. Events need ``EVENT`` columns; observed as ``enrich``: ``events``, ``reads``.
    """
    reads = F.coalesce(F.col("phase") == "enrich", F.lit(False))
    counted = events.select(*EVENT).observe("enrich", F.count(F.lit(1)).alias("events"), F.count_if(reads).alias("reads"))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last, before = _closed_before(spark, folder, batch_id)
        on_time = F.coalesce(F.col("ts_us") >= before, F.lit(False))
        open_path = f"{folder}/open/batch={batch_id}"
        waiting = batch.withColumn("on_time", on_time)
        if last is not None:
            held = spark.read.parquet(f"{folder}/open/batch={last}").filter(F.col("on_time") & (F.col("ts_us") >= before - window_us))
            waiting = waiting.unionByName(held)
        waiting.write.mode("overwrite").parquet(open_path)
        stored = spark.read.parquet(open_path)
        stored.filter("NOT on_time").select("event_id", "ts_us", F.lit("late").alias("fate")).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        open_events = stored.filter("on_time").drop("on_time")
        high = open_events.agg(F.max("ts_us")).first()[0]
        closed = before if high is None else max(before, (high - late_us) // window_us * window_us)
        _decide(spark, folder, batch_id, open_events, before, closed, window_us)
        if last is not None:
            for old in spark.read.schema("closed_us long, batch int").parquet(f"{folder}/closed").filter(F.col("batch") < last).select("batch").collect():
                _delete(spark, f"{folder}/open/batch={old.batch}")

    return _started(counted.writeStream.foreachBatch(step), checkpoint, available_now)


def flush(spark: SparkSession, folder: str, window_us: int) -> None:
    """End of a run: event time moves past every window, so all that is still open is decided.

    A stream that goes on afterwards takes this back: its next micro-batch has the same number and starts from the open events.
    """
    last, before = _closed_before(spark, folder, 1 << 30)
    if last is None or before >= ALWAYS:
        return
    stored = spark.read.parquet(f"{folder}/open/batch={last}")
    still = stored.filter(F.col("on_time") & (F.col("ts_us") >= before - window_us)).drop("on_time")
    _decide(spark, folder, last + 1, still, before, ALWAYS + window_us, window_us)


def _results(spark: SparkSession, folder: str, name: str, shape: str) -> DataFrame:
    """Rows of all finished micro-batches."""
    if not _exists(spark, f"{folder}/closed"):
        return spark.createDataFrame([], shape)
    finished = spark.read.schema("closed_us long, batch int").parquet(f"{folder}/closed").select("batch")
    rows = spark.read.schema(f"{shape}, batch int").parquet(f"{folder}/{name}")
    return rows.join(finished, "batch", "left_semi").drop("batch")


def emitted(spark: SparkSession, folder: str) -> DataFrame:
    """Handshakes as ``complete``, ``replaced`` or ``expired``, and the other events as ``passed``."""
    return _results(spark, folder, "emitted", f"event_id long, host string, pid long, tid long, ts_us long, {', '.join(f'`{n}` string' for n in enrich.READ)}, reads long, status string")


def fates(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each accessor event: ``attached`` or ``orphan``; and of each event that came too late."""
    shape = "event_id long, ts_us long, fate string"
    return _results(spark, folder, "fates", shape).unionByName(_results(spark, folder, "late", shape))


def counters(spark: SparkSession, folder: str, good_path: str, reject_path: str) -> DataFrame:
    """One row of a run: events seen, not decoded, attached, without a handshake, too late, and handed on.

    A replaced handshake is never handed on.
    """
    read = [spark.read.parquet(path).select(F.lit(name).alias("what")) for path, name in ((good_path, "good"), (reject_path, "bad"))]
    what = [*read, fates(spark, folder).select(F.col("fate").alias("what")), emitted(spark, folder).select(F.col("status").alias("what"))]
    rows = reduce(DataFrame.unionByName, what).groupBy("what").agg(F.count(F.lit(1)).alias("n"))

    def total(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("what").isin(*names), F.col("n"))), F.lit(0)).cast("bigint")

    return rows.agg(
        total("good", "bad").alias("seen"), total("bad").alias("decode_errors"), total("attached").alias("enriched"), total("orphan").alias("enrich_orphan"),
        total("late").alias("late"), total("complete", "expired", "passed").alias("spooled"))
