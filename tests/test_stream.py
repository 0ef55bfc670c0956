import json
import random

import pytest
from pyspark.sql import functions as F

from cipherfolio.operators import enrich
from cipherfolio.sources import spool
from cipherfolio.streaming import handshakes

EVENT = {"pid": 5, "tid": 6, "comm": "nginx", "libssl_path": "/lib", "phase": "return", "retval": 1, "timestamp": 1, "observed_version": "TLSv1.3",
         "observed_cipher": "TLS_AES_128_GCM_SHA256", "observed_group": "x25519"}


def test_spool_is_ingested_once(spark, tmp_path):
    source, good, bad, state = (str(tmp_path / n) for n in ("spool", "good", "bad", "state"))
    (tmp_path / "spool").mkdir()
    (tmp_path / "spool" / "a.jsonl").write_text(json.dumps(EVENT) + "\n\nnot json\n[1]\n")
    (tmp_path / "spool" / "b.jsonl").write_text("{}\n")
    (tmp_path / "spool" / ".tmp-c.jsonl").write_text(json.dumps(EVENT))
    (tmp_path / "spool" / "d.txt").write_text(json.dumps(EVENT))
    for _ in range(2):
        handshakes.ingest(spool.stream_spool(spark, source), good, bad, state).awaitTermination(60)
    assert spark.read.parquet(good).count() == 1
    reasons = sorted((r.line_no, r.reject_reason) for r in spark.read.parquet(bad).collect())
    assert reasons == [(1, "event could not be mapped"), (3, "not valid JSON"), (4, "not an object")]
    (tmp_path / "spool" / "e.jsonl").write_text(json.dumps({**EVENT, "pid": 7}))
    handshakes.ingest(spool.stream_spool(spark, source), good, bad, state).awaitTermination(60)
    assert sorted(r.pid for r in spark.read.parquet(good).collect()) == [5, 7]
    batch = spool.judge_lines(spool.read_spool(spark, source))
    verdicts = {r.path.rsplit("/", 1)[1]: r.verdict for r in spool.file_verdicts(batch).collect()}
    assert verdicts == {"a.jsonl": "consumed", "b.jsonl": "rejected", "e.jsonl": "consumed"}


@pytest.mark.parametrize("change,grade,claims", [
    ({}, "full", 3), ({"observed_group": None}, "partial", 2), ({"retval": -1}, "none", 1), ({"phase": "entry"}, "none", 1),
    ({"observed_cipher": "x" * 200}, "partial", 2), ({"observed_version": "\u0007"}, "partial", 3), ({"observed_group": "X25519MLKEM768"}, "full", 3),
])
def test_events_to_findings(spark, change, grade, claims):
    lines = spark.createDataFrame([("p", 1, json.dumps({**EVENT, **change}))], "path string, line_no int, line string")
    good, bad = spool.split_lines(spool.judge_lines(lines))
    assert bad.count() == 0
    events = spool.parse_events(good).withColumn("scan_id", F.lit("s")).withColumn("system", F.lit("app"))
    rows = spool.event_findings(events, F.lit("h"), longest=96).collect()
    assert len(rows) == claims and {r.params["enrichment"] for r in rows} == {grade}
    assert {r.occurrences[0].locator for r in rows} == {"host:h:pid5"}
    if change.get("observed_group", "").__class__ is str and "MLKEM" in change.get("observed_group", ""):
        assert any(r.params.get("hybrid") == "true" for r in rows)


@pytest.mark.parametrize("change", [{"pid": 0}, {"pid": True}, {"pid": "5"}, {"comm": None}, {"comm": "\u0001"}, {"observed_cipher": 5}])
def test_untrusted_events_are_rejected(spark, change):
    lines = spark.createDataFrame([("p", 1, json.dumps({**EVENT, **change}))], "path string, line_no int, line string")
    assert spool.judge_lines(lines).first().reject_reason == "event could not be mapped"


def hold(events, window):
    """The definition, one event at a time."""
    held, out, fate = {}, {}, {}
    for e in sorted(events, key=lambda e: (e["ts_us"], e["event_id"])):
        key = (e["host"], e["pid"], e["tid"])
        if key in held and e["ts_us"] - held[key]["ts_us"] >= window:
            done = held.pop(key)
            out[done["event_id"]] = ("expired", done)
        if e["phase"] == "enrich":
            if key not in held:
                fate[e["event_id"]] = "orphan"
                continue
            fate[e["event_id"]] = "attached"
            held[key].update({n: e[n] for n in enrich.READ if e[n]})
            if all(held[key][n] for n in enrich.READ):
                done = held.pop(key)
                out[done["event_id"]] = ("complete", done)
        elif e["retval"] == 1:
            if key in held:
                out[held[key]["event_id"]] = ("replaced", held[key])
            held[key] = dict(e)
    for e in held.values():
        out[e["event_id"]] = ("expired", e)
    return {k: (s, *[e[n] or None for n in enrich.READ]) for k, (s, e) in out.items()}, fate


def make_events(n, seed):
    rng = random.Random(seed)
    events = []
    for i in range(n):
        pid = 1 if rng.random() < 0.6 else rng.randrange(2, 5)
        values = {name: rng.choice([None, None, "", "v1", "v2"]) for name in enrich.READ}
        events.append({"event_id": i, "host": rng.choice(["h1", "h2"]), "pid": pid, "tid": pid, "ts_us": rng.randrange(0, n * 60), "phase": rng.choice(["return", "enrich", "enrich", "enrich"]),
                       "retval": rng.choice([1, 1, 1, -1]), **values})
    return events


SHAPE = "event_id long, host string, pid long, tid long, ts_us long, phase string, retval long, version string, cipher string, `group` string"


def test_batch_enrichment_matches_the_definition(spark):
    events = make_events(1500, 11)
    want, fate = hold(events, 400)
    rows = spark.createDataFrame([tuple(e[n] for n in ("event_id", "host", "pid", "tid", "ts_us", "phase", "retval", *enrich.READ)) for e in events], SHAPE)
    done, fates = enrich.enrich_handshakes(rows, 400)
    assert {r.event_id: (r.status, r.version, r.cipher, r.group) for r in done.collect()} == want
    assert {r.event_id: r.fate for r in fates.collect()} == fate


def run_enrichment(spark, folder, chunks, window, late_us=0):
    """Each chunk of events is a file of the stream and one run of the query."""
    shape = SHAPE
    names = ("event_id", "host", "pid", "tid", "ts_us", "phase", "retval", *enrich.READ)
    for chunk in chunks:
        spark.createDataFrame([tuple(e[n] for n in names) for e in chunk], shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(shape).parquet(f"{folder}/in")
        assert handshakes.enrich_stream(stream, f"{folder}/out", f"{folder}/state", window, late_us).awaitTermination(120)


def streamed(spark, folder):
    rows = handshakes.emitted(spark, f"{folder}/out").collect()
    done = {r.event_id: (r.status, r.version, r.cipher, r.group) for r in rows if r.status != "passed"}
    fate = {r.event_id: r.fate for r in handshakes.fates(spark, f"{folder}/out").collect()}
    assert len(rows) == len({r.event_id for r in rows})
    return done, fate, {r.event_id for r in rows if r.status == "passed"}


def test_stream_enriches_like_the_batch(spark, tmp_path):
    window = 400
    events = make_events(1200, 4)
    want, fate = hold(events, window)
    order = sorted(events, key=lambda e: (e["ts_us"], e["event_id"]))
    rng = random.Random(1)
    chunks = [order[i : i + 300] for i in range(0, 1200, 300)]
    for a, b in zip(chunks, chunks[1:]):  # the last events of a chunk trade places with the first of the next
        a[-20:], b[:20] = b[:20], a[-20:]
    for chunk in chunks:
        rng.shuffle(chunk)
    late_us = 40 * 60
    run_enrichment(spark, tmp_path, chunks[:2], window, late_us)
    early = streamed(spark, tmp_path)
    assert early[0] and early[0].items() <= want.items() and early[1].items() <= fate.items() and len(early[1]) < len(fate)
    handshakes.flush(spark, f"{tmp_path}/out", window)  # and taken back, as the stream goes on
    run_enrichment(spark, tmp_path, chunks[2:], window, late_us)
    handshakes.flush(spark, f"{tmp_path}/out", window)
    handshakes.flush(spark, f"{tmp_path}/out", window)
    done, fates, passed = streamed(spark, tmp_path)
    assert done == want and fates == fate
    assert passed == {e["event_id"] for e in events if e["phase"] == "return" and e["retval"] != 1}
    kept = [p.name for p in (tmp_path / "out" / "open").iterdir()]
    assert len(kept) <= 2, "older state is cleaned up"


def test_events_of_closed_slices_are_late(spark, tmp_path):
    base = {"host": "h", "pid": 1, "tid": 1, "retval": 1, "version": None, "cipher": None, "group": None}
    first = [{**base, "event_id": i, "ts_us": t, "phase": "return"} for i, t in enumerate((0, 5000, 9000))]
    late = [{**base, "event_id": 10, "ts_us": 100, "phase": "enrich"}, {**base, "event_id": 11, "ts_us": None, "phase": "enrich"}, {**base, "event_id": 12, "ts_us": 9100, "phase": "enrich"}]
    run_enrichment(spark, tmp_path, [first, late], 400)
    handshakes.flush(spark, f"{tmp_path}/out", 400)
    done, fates, _ = streamed(spark, tmp_path)
    assert fates == {10: "late", 11: "late", 12: "attached"} and {k: v[0] for k, v in done.items()} == {0: "expired", 1: "expired", 2: "expired"}


def test_nothing_streamed(spark, tmp_path):
    handshakes.flush(spark, str(tmp_path / "out"), 400)
    assert handshakes.emitted(spark, str(tmp_path / "out")).count() == 0 and handshakes.fates(spark, str(tmp_path / "out")).count() == 0


def test_a_file_of_many_splits_is_numbered_like_the_batch(spark, tmp_path):
    (tmp_path / "spool").mkdir()
    lines = {name: ["" if i % 50 == 0 else json.dumps({**EVENT, "timestamp": i, "comm": "c" * (i % 90 + 1)}) for i in range(n)] for name, n in (("a", 3000), ("b", 1), ("c", 700))}
    for name, rows in lines.items():
        (tmp_path / "spool" / f"{name}.jsonl").write_text("\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        want = {(name, i + 1, i) for name, rows in lines.items() for i, line in enumerate(rows) if line}
        batch = spool.read_spool(spark, str(tmp_path / "spool"))
        assert spark.read.text(str(tmp_path / "spool")).rdd.getNumPartitions() > 5
        assert {(r.path.rsplit("/", 1)[1][0], r.line_no, json.loads(r.line)["timestamp"]) for r in batch.collect()} == want
        stream = spool.stream_spool(spark, str(tmp_path / "spool"))
        watch = handshakes.Observed()
        spark.streams.addListener(watch)
        good, bad, state = (str(tmp_path / n) for n in ("good", "bad", "state"))
        handshakes.ingest(stream, good, bad, state).awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(watch)
        rows = spark.read.parquet(good)
        assert {(r.path.rsplit("/", 1)[1][0], r.line_no, r.timestamp) for r in rows.collect()} == want and rows.count() == len(want)
        assert watch.totals["ingest"]["seen"] == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_run_counts_what_became_of_its_events(spark, tmp_path):
    (tmp_path / "spool").mkdir()
    name = str(tmp_path / "spool" / "a.jsonl")
    threads = [(5, 1, "return"), (5, 2, "enrich"), (6, 3, "enrich"), (5, 4, "return"), (7, 5, "entry"), (5, 900, "enrich")]
    lines = [json.dumps({**EVENT, "pid": p, "tid": p, "timestamp": t, "phase": phase, "observed_group": None}) for p, t, phase in threads]
    open(name, "w").write("\n".join([*lines, "broken", "[]"]))
    good, bad, state, out = (str(tmp_path / n) for n in ("good", "bad", "state", "out"))
    handshakes.ingest(spool.stream_spool(spark, str(tmp_path / "spool")), good, bad, state).awaitTermination(120)
    shape = spark.read.parquet(good).schema
    events = spark.readStream.schema(shape).parquet(good).selectExpr(
        "timestamp as event_id", "'h' as host", "pid", "tid", "timestamp as ts_us", "phase", "retval", "observed_version as version", "observed_cipher as cipher", "observed_group as `group`")
    assert handshakes.enrich_stream(events, out, state + "2", 100).awaitTermination(120)
    handshakes.flush(spark, out, 100)
    row = handshakes.counters(spark, out, good, bad).first().asDict()
    assert row == {"seen": 8, "decode_errors": 2, "enriched": 1, "enrich_orphan": 2, "late": 0, "spooled": 2}


def test_findings_are_appended_once(spark, tmp_path):
    lines = spark.createDataFrame([("p", 1, json.dumps(EVENT)), ("p", 2, json.dumps({**EVENT, "pid": 9, "observed_group": None}))], "path string, line_no int, line string")
    spool.parse_events(spool.split_lines(spool.judge_lines(lines))[0]).write.parquet(str(tmp_path / "good"))
    shape = spark.read.parquet(str(tmp_path / "good")).schema
    for _ in range(2):
        events = spark.readStream.schema(shape).parquet(str(tmp_path / "good")).withColumn("scan_id", F.lit("s")).withColumn("system", F.lit("app"))
        assert handshakes.append_findings(events, str(tmp_path / "found"), str(tmp_path / "state"), host="h").awaitTermination(60)
    found = spark.read.parquet(str(tmp_path / "found")).collect()
    assert sorted(r.occurrences[0].locator for r in found) == ["host:h:pid5"] * 3 + ["host:h:pid9"] * 2
