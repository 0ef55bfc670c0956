"""Runtime events, answer-key scores, fixes, documents and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherfolio.operators import correlate, enrich, kpi, remediate, store
from cipherfolio.operators import inventory as inv
from cipherfolio.operators.durable import durable, scratch
from cipherfolio.plans import oracle_base as O
from cipherfolio.plans import testbed as B
from cipherfolio.plans.correlation_queries import CORRELATED, DRIFT
from cipherfolio.plans.inventory_queries import components, joined, param, scored
from cipherfolio.plans.metric_queries import TODAY, artefacts
from cipherfolio.sources import cbom, config_text, detect, files, packages, spool
from cipherfolio.streaming import handshakes

WINDOW_US = 6 * 3600 * 1_000_000
LINES_WINDOW_US = 400 * 1_000_000
FIRST_DAY_US = 1_704_067_200_000_000


def _judged(spark, sf_dir):
    return spool.judge_lines(B.event_lines(spark, sf_dir), B.MAX_EVENT_LINE)


def spool_batch(spark, sf_dir):
    good, _ = spool.split_lines(_judged(spark, sf_dir))
    return spool.parse_events(good).select("path", "line_no", "pid", "tid", "comm", "phase", "retval", *spool.FIELDS)


def spool_rejects(spark, sf_dir):
    _, bad = spool.split_lines(_judged(spark, sf_dir))
    return bad


def spool_verdicts(spark, sf_dir):
    return spool.file_verdicts(_judged(spark, sf_dir))


def reader_gaps(spark, sf_dir):
    """Manifests of which some are cut short, and event files with damaged lines: what no reader could take."""
    manifests = B.manifest_files(spark, sf_dir).withColumn("text", F.expr("case when path like '%package.json' and length(path) % 2 = 0 then left(text, 10) else text end"))
    lines = spool.line_gaps(_judged(spark, sf_dir)).select(F.lit("base").alias("scan_id"), F.lit("runtime-spool").alias("scanner"), "path", "kind", "reason")
    return files.text_gaps(manifests).unionByName(lines)


#: First bytes of private and public keys; the rest comes from the document. Kinds of planting by id.
_PRIVATE_HEAD, _PUBLIC_HEAD = "302e020100300506032b657004220420", "302a300506032b6570032100"
_HEAD64 = "md5(text) || md5(lang || text)"
_KEY_HEX, _PUB_HEX = f"'{_PRIVATE_HEAD}' || {_HEAD64}", f"'{_PUBLIC_HEAD}' || {_HEAD64}"
PLANTED_BY_KIND = {
    0: "'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5(text) || chr(10) || '-----END RSA PRIVATE KEY-----' || chr(10) || text",
    1: """text || chr(10) || 'api_secret = "' || md5(text) || 'Zq"'""",
    2: f"text || chr(10) || 'x ' || {_KEY_HEX} || ' y'",
    3: f"text || chr(10) || 'blob(' || base64(unhex({_KEY_HEX})) || ')'",
    4: f"text || chr(10) || regexp_replace({_KEY_HEX}, '(..)', '\\\\\\\\x$1') || ' end'",
    5: f"text || chr(10) || 'pairs = ' || trim(regexp_replace({_KEY_HEX}, '(..)', '$1 ')) || ';'",
    6: "text || chr(10) || 'DB_PASSWORD=' || md5(text) || 'qZ'",
    7: f"text || chr(10) || 'pub = ' || base64(unhex({_PUB_HEX}))",
    8: """'k = "Zq' || left(md5(text), 10) || '" end'""",
}


def normalise_redacted(spark, sf_dir):
    """Sightings of findings whose snippets are whole documents with planted key material, one row in nine a key's."""
    docs = B.dealt(B.table(spark, sf_dir, "documents").filter("text is not null"), "doc_id")
    planted = "case cast(doc_id % 9 as int) " + " ".join(f"when {kind} then {text}" for kind, text in PLANTED_BY_KIND.items()) + " end"
    found = docs.withColumn("planted", F.expr(planted)).selectExpr(
        "'base' as scan_id", "source as system", "'source' as scanner_id", "'declared' as view", "case when doc_id % 9 = 8 then 'key' else 'algorithm' end as asset_type", "'pke' as primitive", "'RSA' as algorithm",
        "map('note', planted) as params", "'sign' as usage", "true as configurable",
        "array(named_struct('view', 'declared', 'locator', concat('doc/', doc_id, '.py:1'), 'detail', 'rule=planted', 'snippet', planted)) as occurrences", "1.0D as confidence")
    return inv.sightings(inv.normalise(found)).select("system", "locator", F.md5("snippet").alias("snippet"), F.length("snippet").cast("bigint").alias("length"))


def kpi_gate(spark, sf_dir):
    found = kpi.finding_scores(_emitted(spark, sf_dir), _planted(spark, sf_dir), ("svc/f2", "host:h2"))
    drift = kpi.drift_scores(_emitted_drift(spark, sf_dir), *_drift_key(spark, sf_dir))
    rows = kpi.passes(found, drift)
    return rows.select(F.round("recall", 6).alias("recall"), "decoy_hits", F.round("drift_recall", 6).alias("drift_recall"), "invented", "passes")


def event_findings(spark, sf_dir):
    good, _ = spool.split_lines(_judged(spark, sf_dir))
    events = spool.parse_events(good).withColumn("scan_id", F.lit("base")).withColumn("system", F.lit("sys"))
    rows = spool.event_findings(events, F.lit("h1"))
    o = F.get("occurrences", F.lit(0))
    return rows.groupBy(
        "asset_type", "primitive", "algorithm", "usage", o["locator"].alias("locator"), o["snippet"].alias("snippet"),
        *[param(n).alias(n) for n in ("enrichment", "pending_enrichment", "version", "cipher_suite", "group", "hybrid")],
    ).agg(F.count(F.lit(1)).alias("n"))


def enrich_window(spark, sf_dir):
    handshakes, _ = enrich.enrich_handshakes(B.handshake_events(spark, sf_dir), WINDOW_US)
    return handshakes.select("event_id", "host", "pid", "tid", "version", "cipher", "group", "reads", "status")


def enrich_fates(spark, sf_dir):
    _, fates = enrich.enrich_handshakes(B.handshake_events(spark, sf_dir), WINDOW_US)
    return fates.select("event_id", "fate")


def _enriched_stream(spark, sf_dir):
    """The events as a stream that is stopped and resumed twice, then flushed: the folder of its results."""
    folder = scratch(spark, "enrichment")
    events = B.handshake_events(spark, sf_dir)
    third = F.greatest(F.lit(0), F.least(F.lit(2), F.floor((F.col("ts_us") - F.lit(FIRST_DAY_US)) / F.lit(10 * 86_400_000_000))))
    for part in range(3):
        events.filter(third == part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        handshakes.enrich_stream(stream, f"{folder}/out", f"{folder}/state", WINDOW_US).awaitTermination()
    handshakes.flush(spark, f"{folder}/out", WINDOW_US)
    return f"{folder}/out"


def stream_window(spark, sf_dir):
    rows = handshakes.emitted(spark, _enriched_stream(spark, sf_dir)).filter("status <> 'passed'")
    return rows.select("event_id", "host", "pid", "tid", "version", "cipher", "group", "reads", "status")


def stream_fates(spark, sf_dir):
    return handshakes.fates(spark, _enriched_stream(spark, sf_dir)).select("event_id", "fate")


def _spool_files(spark, sf_dir):
    """Event lines as text files of 1,000 lines, ingested as a stream: ``(accepted, rejected, folder)``."""
    folder = scratch(spark, "spool")
    lines = B.table(spark, sf_dir, "events").selectExpr("concat('f', event_id div 1000) as path", "event_id", f"{B.EVENT_LINE} as line")
    lines.repartition("path").sortWithinPartitions("path", "event_id").select("path", "line").write.partitionBy("path").text(f"{folder}/in")
    stream = spool.stream_spool(spark, f"{folder}/in/path=*", suffixes=(".txt",))
    handshakes.ingest(stream, f"{folder}/good", f"{folder}/bad", f"{folder}/state", max_bytes=B.MAX_EVENT_LINE).awaitTermination()
    return f"{folder}/good", f"{folder}/bad", folder


def stream_spool(spark, sf_dir):
    """Accepted and rejected lines of the streamed files with their places."""
    good, bad, _ = _spool_files(spark, sf_dir)
    file = F.regexp_extract("path", "path=([^/]+)", 1).alias("file")
    accepted = spark.read.parquet(good).select(file, "line_no", F.col("timestamp").alias("event_id"), F.lit(None).cast("string").alias("reject_reason"))
    return accepted.unionByName(spark.read.parquet(bad).select(file, "line_no", F.lit(None).cast("bigint").alias("event_id"), "reject_reason"))


def stream_counters(spark, sf_dir):
    """What a run over the spooled lines reports, each line one second after the one before."""
    good, bad, folder = _spool_files(spark, sf_dir)
    named = {short: f"nullif(observed_{short}, '') as `{short}`" for short in ("version", "cipher", "group")}
    events = spark.readStream.schema(spark.read.parquet(good).schema).parquet(good).selectExpr(
        "timestamp as event_id", "'h' as host", "pid", "tid", "timestamp * 1000000 as ts_us", "phase", "retval", *named.values())
    handshakes.enrich_stream(events, f"{folder}/out", f"{folder}/state2", LINES_WINDOW_US).awaitTermination()
    handshakes.flush(spark, f"{folder}/out", LINES_WINDOW_US)
    return handshakes.counters(spark, f"{folder}/out", good, bad)


def _emitted(spark, sf_dir):
    rows = B.findings(spark, sf_dir)
    return rows.select("view", "algorithm", "asset_type", param("endpoint").alias("endpoint"), F.explode("occurrences").alias("o")).select(
        "view", "algorithm", "asset_type", "endpoint", F.col("o.locator").alias("locator"))


def _planted(spark, sf_dir):
    """Every (view, algorithm, place) of the first two places, and five inventions."""
    rows = _emitted(spark, sf_dir)
    place = F.regexp_extract("locator", r"(svc/f[01]|host:h[01])", 1)
    real = rows.select("view", "algorithm", place.alias("locator_contains")).filter("locator_contains <> ''").distinct()
    made = B.table(spark, sf_dir, "region").selectExpr(
        "element_at(array('declared', 'shipped', 'observed'), r_regionkey % 3 + 1) as view", "concat('INVENTED-', r_regionkey) as algorithm", "'svc/f0' as locator_contains")
    merged = real.unionByName(made)
    return merged.select(
        F.concat_ws("/", "view", "algorithm", "locator_contains").alias("id"), "view", "algorithm", "locator_contains",
        F.when(F.col("algorithm") == "RSA", F.lit("algorithm")).when(F.col("algorithm") == "AES", F.lit("key")).alias("asset_type"),
        F.when((F.col("algorithm") == "ECDSA") & (F.col("view") == "declared"), F.lit("ep1:443")).alias("endpoint"), (F.col("algorithm") == "ML-KEM").alias("known_gap"))


def kpi_findings(spark, sf_dir):
    rows = kpi.finding_scores(_emitted(spark, sf_dir), _planted(spark, sf_dir), ("svc/f2", "host:h2"))
    return rows.select("view", "planted", "found", F.round("recall", 6).alias("recall"), "emitted", "decoy_hits", F.round("precision", 6).alias("precision"))


def _drift_key(spark, sf_dir):
    """Expected drifts per endpoint and kind, quiet endpoints and limits."""
    ends = B.table(spark, sf_dir, "supplier").selectExpr("concat('ep', s_suppkey % 4, ':443') as endpoint").distinct()
    kinds = F.array(*[F.lit(k) for k in (*correlate.KINDS, "never-seen")])
    expected = ends.filter("endpoint <> 'ep3:443'").select("endpoint", F.explode(kinds).alias("kind")).select(
        F.concat_ws("/", "endpoint", "kind").alias("id"), "endpoint", "kind",
        F.when(F.col("kind") == correlate.DOWNGRADE, F.lit("TLSv1.3")).alias("declared"),
        F.when(F.col("kind") == correlate.OUTSIDE_SET, F.lit("CHACHA20")).alias("observed_contains"))
    quiet = ends.filter("endpoint = 'ep3:443'")
    limits = ends.filter("endpoint = 'ep2:443'").select("endpoint", F.lit(correlate.DOWNGRADE).alias("kind")).unionByName(
        ends.filter("endpoint = 'ep1:443'").select("endpoint", F.lit(None).cast("string").alias("kind")))
    return expected, quiet, limits


def _emitted_drift(spark, sf_dir):
    """Drifts with the endpoint of their component. Both are read several times, so the findings are folded once."""
    parts = durable(components(spark, sf_dir))
    found = correlate.drifts_of(correlate.members(parts))
    place = parts.select("scan_id", "system", "bom_ref", param("endpoint").alias("endpoint"))
    return durable(found.join(place, ["scan_id", "system", "bom_ref"]))


def kpi_drift(spark, sf_dir):
    rows = kpi.drift_scores(_emitted_drift(spark, sf_dir), *_drift_key(spark, sf_dir))
    return rows.select("expected", "found", "emitted", "invented", "limited", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def _fix_files(spark, sf_dir):
    nginx = B.text_files(spark, sf_dir, "concat('conf/p', p_partkey, '/nginx.conf')", B.NGINX_TEXT)
    openssl = B.text_files(spark, sf_dir, "concat('conf/p', p_partkey, '/openssl.cnf')", B.OPENSSL_OLD_TEXT)
    code = B.text_files(spark, sf_dir, "concat('svc/p', p_partkey, '.py')", B.MD5_TEXT)
    return nginx.unionByName(openssl), code


def fix_verify(spark, sf_dir):
    config, code = _fix_files(spark, sf_dir)
    context = B.targets(spark, sf_dir).withColumn("exposure", F.lit("internal"))
    out = None
    for rows, detector in ((config, config_text.config_findings), (code, detect.source_findings)):
        found = durable(detector(rows))
        proposals = remediate.propose(found, files.lines(rows))
        one = remediate.verify(proposals, found, rows, detector, remediate.critical_by(context)).select("path", "template", "verified", "new_line", "new_findings")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("path", "template", "verified", "new_line", "new_findings").agg(F.count(F.lit(1)).alias("n"))


def combined_scans(spark, sf_dir):
    """Two stored scans as one: a shared artefact keeps a row and a verdict of each."""
    root = scratch(spark, "store")
    rows, drifts = correlate.correlate(scored(spark, sf_dir))
    scans = B.table(spark, sf_dir, "region").selectExpr("explode(array('base', 'head')) as scan_id").distinct().selectExpr(
        "scan_id", "'repo' as ref", "cast(null as string) as system", "'scan' as kind", "cast(null as string) as parent_scan_id", "'other' as sector", "'unknown' as exposure",
        "11 as z_years", "array('source') as scanners_ran", "timestamp'2026-01-01' as created_at")
    store.save_scans(rows, drifts, scans, root)
    both, _ = store.combined(spark, root, ["base", "head"], "both")
    return both.select("scan_id", "system", "bom_ref", "name", F.col("base_score").cast("bigint").alias("base_score"))


def dependency_floor(spark, sf_dir):
    rows = B.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "case when p_size % 2 = 0 then 'distro' else 'pypi' end as ecosystem", "case when p_size % 2 = 0 then 'openssl' else 'pyjwt' end as package",
        "case p_size % 3 when 0 then concat('>=3.', p_size % 8, '.0') when 1 then '*' else concat('3.', p_size % 9, '.1') end as version", "p_size % 3 < 2 as version_is_range")
    return remediate.dependency_floor(rows, packages.libraries(spark)).select("p_partkey", "bound", "refusal", "bump_to")


def diff_statistics(spark, sf_dir):
    """Document lines as a diff: files, added, removed lines, and standards cited."""
    text = """concat('--- a/x', chr(10), '+++ b/x', chr(10), '+', replace(text, chr(10), concat(chr(10), case when doc_id % 2 = 0 then '+' else '-' end)), chr(10), ' FIPS ', doc_id % 300, '-', doc_id % 5)"""
    rows = B.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{text} as diff")
    return rows.select("doc_id", remediate.diff_stats(F.col("diff")).alias("d"), remediate.fips_tag(F.col("diff")).alias("tag")).select("doc_id", "d.*", "tag")


def cbom_json_roundtrip(spark, sf_dir):
    rows = cbom.read_lines(cbom.component_json(scored(spark, sf_dir)))
    return rows.select(
        "scan_id", "system", "bom_ref", "name", "algorithm", "asset_type", "usage", joined("views"), "configurable", F.round("confidence", 4).alias("confidence"),
        param("key_size").alias("key_size"), param("endpoint").alias("endpoint"), "band", F.col("score").cast("bigint").alias("score"), "deadline",
        joined("labels"), joined("fired_rules"), "quantum_status", F.try_element_at("categories", F.lit("quantum")).alias("c_quantum"), "x_years")


def document_serial(spark, sf_dir):
    return cbom.document_serial(components(spark, sf_dir))


def export_csv(spark, sf_dir):
    return store.inventory_export(artefacts(spark, sf_dir))


def export_roadmap(spark, sf_dir):
    return store.roadmap_export(scored(spark, sf_dir), TODAY)


QUERIES = {
    f.__name__: f
    for f in (
        spool_batch, spool_rejects, spool_verdicts, event_findings, enrich_window, enrich_fates, stream_window, stream_fates, stream_spool, stream_counters, kpi_findings, kpi_drift, fix_verify,
        reader_gaps, normalise_redacted, combined_scans, kpi_gate, dependency_floor, diff_statistics, cbom_json_roundtrip, document_serial, export_csv, export_roadmap,
    )
}

_EVENTS = f"""l AS (SELECT *, {B.EVENT_FILE} AS path, CAST(event_id AS INTEGER) AS line_no, {B.EVENT_LINE} AS line FROM events),
j AS (SELECT *, CASE WHEN octet_length(encode(line)) > {B.MAX_EVENT_LINE} THEN 'line too long' WHEN NOT json_valid(line) THEN 'not valid JSON'
    WHEN json_type(line) <> 'OBJECT' THEN 'not an object'
    WHEN NOT coalesce(json_type(line, '$.pid') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(line, '$.pid') AS BIGINT) BETWEEN 1 AND 4194304
      AND json_type(line, '$.comm') = 'VARCHAR', FALSE) THEN 'event could not be mapped'
    WHEN json_extract_string(line, '$.phase') = 'return' AND json_extract_string(line, '$.retval') = '1'
      AND coalesce(json_type(line, '$.observed_cipher'), 'VARCHAR') NOT IN ('VARCHAR', 'NULL') THEN 'event could not be mapped' END AS reject_reason FROM l)
"""
_EVENT_ROWS = """e AS (SELECT event_id, 'h' || event_id % 2 AS host, 1000 + user_id AS pid, user_id AS tid, epoch_us(ts) AS ts_us, event_type = 'signup' AS ret, event_type = 'signup' AND event_id % 5 <> 0 AS done,
    CASE WHEN event_id % 3 = 0 THEN 'TLSv1.3' END AS version, CASE event_type WHEN 'click' THEN 'TLS_AES_256_GCM_SHA384' END AS cipher, CASE event_type WHEN 'view' THEN 'x25519' END AS kex
  FROM events),
"""
#: Accepted spool lines as the same kind of rows, one second apart.
_LINE_ROWS = """e AS (SELECT event_id, 'h' AS host, 1000 + user_id AS pid, user_id AS tid, event_id * 1000000 AS ts_us, event_type = 'signup' AS ret, event_type = 'signup' AND event_id % 5 <> 0 AS done,
    CASE WHEN event_id % 3 = 0 THEN 'TLSv1.3' END AS version, CASE event_id % 4 WHEN 0 THEN 'TLS_AES_256_GCM_SHA384' WHEN 1 THEN 'TLS_CHACHA20_POLY1305_SHA256' END AS cipher,
    CASE WHEN event_id % 7 = 0 THEN 'X25519MLKEM768' WHEN event_id % 7 < 3 THEN 'x25519' END AS kex
  FROM j WHERE reject_reason IS NULL),
"""
_HOLDERS = """h AS (SELECT *, max(CASE WHEN done THEN (ts_us, event_id) END) OVER (PARTITION BY host, pid, tid ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e),
a AS (SELECT h.*, CASE WHEN prev IS NOT NULL AND ts_us - prev[1] < {window} THEN prev[2] END AS holder FROM h),
r AS (SELECT a.*, row_number() OVER w AS k,
    coalesce(max(CASE WHEN a.version IS NOT NULL THEN (a.ts_us, a.event_id, a.version) END) OVER p IS NOT NULL OR o.version IS NOT NULL, FALSE)
      AND (max(CASE WHEN a.cipher IS NOT NULL THEN 1 END) OVER p IS NOT NULL OR o.cipher IS NOT NULL)
      AND (max(CASE WHEN a.kex IS NOT NULL THEN 1 END) OVER p IS NOT NULL OR o.kex IS NOT NULL) AS full_before
  FROM a JOIN e o ON o.event_id = a.holder WHERE NOT a.ret
  WINDOW w AS (PARTITION BY a.holder ORDER BY a.ts_us, a.event_id), p AS (PARTITION BY a.holder ORDER BY a.ts_us, a.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT * FROM r WHERE NOT (full_before AND k > 1)),
v AS (SELECT holder, count(*) AS reads, arg_max(version, (ts_us, event_id)) FILTER (version IS NOT NULL) AS version, arg_max(cipher, (ts_us, event_id)) FILTER (cipher IS NOT NULL) AS cipher,
    arg_max(kex, (ts_us, event_id)) FILTER (kex IS NOT NULL) AS kex FROM c GROUP BY ALL)
"""
_HELD = _EVENT_ROWS + _HOLDERS.replace("{window}", str(WINDOW_US))
_HELD_LINES = _LINE_ROWS + _HOLDERS.replace("{window}", str(LINES_WINDOW_US))
_KPI = """, em AS (SELECT view, algorithm, asset_type, endpoint, locator FROM wide),
pl AS (SELECT *, view || '/' || algorithm || '/' || lc AS id, CASE algorithm WHEN 'RSA' THEN 'algorithm' WHEN 'AES' THEN 'key' END AS wt,
    CASE WHEN algorithm = 'ECDSA' AND view = 'declared' THEN 'ep1:443' END AS we
  FROM (SELECT DISTINCT view, algorithm, regexp_extract(locator, '(svc/f[01]|host:h[01])', 1) AS lc FROM em WHERE regexp_matches(locator, '(svc/f[01]|host:h[01])')
        UNION ALL SELECT ['declared', 'shipped', 'observed'][r_regionkey % 3 + 1], 'INVENTED-' || r_regionkey, 'svc/f0' FROM region)),
g AS (SELECT *, EXISTS (SELECT 1 FROM em WHERE em.view = pl.view AND em.algorithm = pl.algorithm AND contains(em.locator, pl.lc)
    AND (pl.wt IS NULL OR pl.wt = em.asset_type) AND (pl.we IS NULL OR pl.we = em.endpoint)) AS found FROM pl WHERE algorithm <> 'ML-KEM')
"""

ORACLES = {
    "reader_gaps": "WITH " + _EVENTS + """,
        m AS (SELECT concat('repo/p', p_partkey, '/package.json') AS path FROM part WHERE p_size % 5 < 3
              UNION ALL SELECT concat('repo/p', p_partkey, '/node_modules/x/package.json') FROM part WHERE p_size % 5 = 0)
        SELECT 'base' AS scan_id, 'deps' AS scanner, path, 'unparsed' AS kind, 'not valid JSON' AS reason FROM m WHERE length(path) % 2 = 0
        UNION ALL SELECT DISTINCT 'base', 'runtime-spool', path, CASE WHEN valid > 0 THEN 'partially-parsed' ELSE 'unparsed' END, reject_reason
        FROM (SELECT path, reject_reason, count(*) FILTER (reject_reason IS NULL) OVER (PARTITION BY path) AS valid FROM j) WHERE reject_reason IS NOT NULL""",
    "spool_batch": "WITH " + _EVENTS + """
        SELECT path, line_no, CAST(json_extract_string(line, '$.pid') AS BIGINT) AS pid, CAST(json_extract_string(line, '$.tid') AS BIGINT) AS tid, json_extract_string(line, '$.comm') AS comm,
          json_extract_string(line, '$.phase') AS phase, CAST(json_extract_string(line, '$.retval') AS BIGINT) AS retval, json_extract_string(line, '$.observed_version') AS observed_version,
          json_extract_string(line, '$.observed_cipher') AS observed_cipher, json_extract_string(line, '$.observed_group') AS observed_group FROM j WHERE reject_reason IS NULL""",
    "spool_rejects": "WITH " + _EVENTS + "SELECT path, line_no, reject_reason, line FROM j WHERE reject_reason IS NOT NULL",
    "spool_verdicts": "WITH " + _EVENTS + """
        SELECT path, count(*) FILTER (reject_reason IS NULL) AS valid, count(reject_reason) AS skipped, CASE WHEN count(*) FILTER (reject_reason IS NULL) > 0 THEN 'consumed' ELSE 'rejected' END AS verdict
        FROM j GROUP BY ALL""",
    "event_findings": "WITH " + _EVENTS + """,
        n AS (SELECT *, event_type = 'signup' AND event_id % 5 <> 0 AS done FROM j WHERE reject_reason IS NULL),
        p AS (SELECT 1000 + user_id AS pid, CASE user_id % 3 WHEN 0 THEN 'nginx' WHEN 1 THEN 'envoy' ELSE 'java' END AS comm,
          CASE WHEN done AND event_id % 3 = 0 THEN 'TLSv1.3' END AS version,
          CASE WHEN done AND event_id % 4 = 0 THEN 'TLS_AES_256_GCM_SHA384' WHEN done AND event_id % 4 = 1 THEN 'TLS_CHACHA20_POLY1305_SHA256' END AS suite,
          CASE WHEN done AND event_id % 7 = 0 THEN 'X25519MLKEM768' WHEN done AND event_id % 7 < 3 THEN 'x25519' END AS grp FROM n),
        q AS (SELECT *, (version IS NOT NULL)::INT + (suite IS NOT NULL)::INT + (grp IS NOT NULL)::INT AS k FROM p),
        s AS (SELECT *, CASE k WHEN 3 THEN 'full' WHEN 0 THEN 'none' ELSE 'partial' END AS enrichment, CASE k WHEN 0 THEN 'true' END AS pending_enrichment FROM q),
        u AS (SELECT 'protocol' AS asset_type, 'unknown' AS primitive, 'TLS' AS algorithm, 'unknown' AS usage, pid, comm, enrichment, pending_enrichment, version, NULL AS cipher_suite, NULL AS "group", NULL AS hybrid FROM s
          UNION ALL SELECT 'algorithm', CASE WHEN contains(suite, 'CHACHA20') THEN 'stream-cipher' ELSE 'block-cipher' END, suite, 'encrypt', pid, comm, enrichment, pending_enrichment, version, suite, NULL, NULL FROM s WHERE suite IS NOT NULL
          UNION ALL SELECT 'algorithm', 'key-agreement', grp, 'key-exchange', pid, comm, enrichment, pending_enrichment, version, NULL, grp, CASE WHEN contains(grp, 'MLKEM') THEN 'true' END FROM s WHERE grp IS NOT NULL)
        SELECT * EXCLUDE (pid, comm), 'host:h1:pid' || pid AS locator, comm || ' via /usr/lib/libssl.so.3' AS snippet, count(*) AS n FROM u GROUP BY ALL""",
    "enrich_window": "WITH " + _HELD + """,
        heirs AS (SELECT DISTINCT holder FROM a WHERE done AND holder IS NOT NULL),
        m AS (SELECT e.event_id, e.host, e.pid, e.tid, coalesce(v.version, e.version) AS version, coalesce(v.cipher, e.cipher) AS cipher, coalesce(v.kex, e.kex) AS kex, coalesce(v.reads, 0) AS reads
              FROM e LEFT JOIN v ON v.holder = e.event_id WHERE e.done)
        SELECT event_id, host, pid, tid, version, cipher, kex AS "group", reads, CASE WHEN version IS NOT NULL AND cipher IS NOT NULL AND kex IS NOT NULL AND reads > 0 THEN 'complete'
          WHEN event_id IN (SELECT holder FROM heirs) THEN 'replaced' ELSE 'expired' END AS status FROM m""",
    "enrich_fates": "WITH " + _HELD + """
        SELECT event_id, CASE WHEN full_before AND k > 1 THEN 'orphan' ELSE 'attached' END AS fate FROM r
        UNION ALL SELECT event_id, 'orphan' FROM a WHERE NOT ret AND holder IS NULL""",
    "kpi_findings": "WITH " + O.FINDINGS + _KPI + """,
        s AS (SELECT coalesce(view, 'OVERALL') AS view, count(*) AS planted, count(*) FILTER (found) AS found FROM g GROUP BY ROLLUP (view)),
        t AS (SELECT count(*) AS emitted, count(*) FILTER (contains(locator, 'svc/f2') OR contains(locator, 'host:h2')) AS decoy_hits FROM em)
        SELECT view, planted, found, round(found / planted, 6) AS recall, CASE view WHEN 'OVERALL' THEN emitted END AS emitted, CASE view WHEN 'OVERALL' THEN decoy_hits END AS decoy_hits,
          CASE view WHEN 'OVERALL' THEN round((emitted - decoy_hits) / emitted, 6) END AS precision FROM s, t""",
    "kpi_drift": "WITH " + O.COMPONENTS + DRIFT + """,
        em AS (SELECT d.kind, d.declared, d.observed, d.records, c.endpoint FROM drifts d JOIN comp c USING (scan_id, system, bom_ref)),
        ends AS (SELECT DISTINCT 'ep' || (s_suppkey % 4) || ':443' AS endpoint FROM supplier),
        ex AS (SELECT endpoint || '/' || kind AS id, endpoint, kind, CASE kind WHEN 'protocol-downgrade' THEN 'TLSv1.3' END AS dec, CASE kind WHEN 'cipher-outside-declared-set' THEN 'CHACHA20' END AS oc
               FROM ends, (SELECT unnest(['shipped-cannot-do-declared', 'declared-pqc-observed-classical', 'declared-pqc-observed-unconfirmed', 'protocol-downgrade', 'cipher-outside-declared-set', 'never-seen']) AS kind)
               WHERE endpoint <> 'ep3:443'),
        fx AS (SELECT ex.id, bool_or(em.kind IS NOT NULL) AS found FROM ex LEFT JOIN em ON em.kind = ex.kind AND em.endpoint = ex.endpoint AND (ex.dec IS NULL OR ex.dec = em.declared)
               AND (ex.oc IS NULL OR contains(em.observed, ex.oc)) GROUP BY ALL),
        cl AS (SELECT em.*, EXISTS (SELECT 1 FROM ex WHERE em.kind = ex.kind AND em.endpoint = ex.endpoint AND (ex.dec IS NULL OR ex.dec = em.declared) AND (ex.oc IS NULL OR contains(em.observed, ex.oc))) AS matched FROM em),
        t AS (SELECT CAST(sum(records) AS BIGINT) AS emitted, CAST(coalesce(sum(records) FILTER (endpoint = 'ep3:443'), 0) AS BIGINT) AS invented,
              CAST(coalesce(sum(records) FILTER (NOT matched AND (endpoint = 'ep1:443' OR (endpoint = 'ep2:443' AND kind = 'protocol-downgrade'))), 0) AS BIGINT) AS limited FROM cl)
        SELECT (SELECT count(*) FROM ex) AS expected, (SELECT count(*) FROM fx WHERE found) AS found, emitted, invented, limited,
          round((SELECT count(*) FROM fx WHERE found) / (SELECT count(*) FROM ex), 6) AS recall, round((emitted - limited - invented) / (emitted - limited), 6) AS precision FROM t""",
    "fix_verify": """WITH x AS (
          SELECT concat('conf/p', p_partkey, '/nginx.conf') AS path, 'nginx-weak-protocol' AS template, '    ssl_protocols TLSv1.3;' AS new_line FROM part WHERE p_size % 4 = 0
          UNION ALL SELECT concat('conf/p', p_partkey, '/nginx.conf'), 'nginx-weak-protocol', '    ssl_protocols TLSv1.3;' FROM part WHERE p_size % 11 = 0
          UNION ALL SELECT concat('conf/p', p_partkey, '/nginx.conf'), 'nginx-add-hybrid-group', '    ssl_ecdh_curve X25519MLKEM768;' FROM part WHERE p_size % 7 IN (3, 4)
          UNION ALL SELECT concat('conf/p', p_partkey, '/openssl.cnf'), 'openssl-cnf-groups', 'Groups = X25519MLKEM768:P-256:X448 # keep' FROM part
          UNION ALL SELECT concat('conf/p', p_partkey, '/openssl.cnf'), 'openssl-cnf-groups', 'MinProtocol = TLSv1.2' FROM part WHERE p_size % 2 = 0
          UNION ALL SELECT concat('svc/p', p_partkey, '.py'), 'md5-to-sha256', CASE WHEN p_size % 3 = 1 AND p_size % 5 <> 0 THEN '    h = hashlib.sha256(data).hexdigest()' END FROM part)
        SELECT path, template, new_line IS NOT NULL AS verified, new_line, CASE WHEN new_line IS NULL THEN 0 ELSE 1 END AS new_findings, count(*) AS n FROM x GROUP BY ALL""",
    "dependency_floor": """SELECT p_partkey, bound, CASE WHEN p_size % 2 = 1 THEN 'no confirmed post-quantum release of this library' WHEN bound IS NULL THEN 'the version names no lower bound'
          WHEN CAST(split_part(bound, '.', 2) AS INTEGER) >= 5 THEN 'already at or above the confirmed release' END AS refusal,
          CASE WHEN p_size % 2 = 0 AND bound IS NOT NULL AND CAST(split_part(bound, '.', 2) AS INTEGER) < 5 THEN '3.5.0' END AS bump_to
        FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN concat('3.', p_size % 8, '.0') WHEN 2 THEN concat('3.', p_size % 9, '.1') END AS bound FROM part)""",
    "diff_statistics": """SELECT doc_id, 1 AS files, 1 + CASE WHEN doc_id % 2 = 0 THEN k ELSE 0 END AS added, CASE WHEN doc_id % 2 = 1 THEN k ELSE 0 END AS removed,
          CASE WHEN doc_id % 300 >= 10 THEN 'FIPS ' || (doc_id % 300) || '-' || (doc_id % 5) END AS tag
        FROM (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS k FROM documents)""",
    "cbom_json_roundtrip": "WITH " + O.VERDICT + """
        SELECT scan_id, system, bom_ref, name, algorithm, asset_type, usage, views, configurable, round(confidence, 4) AS confidence, key_size, endpoint, band, CAST(score AS BIGINT) AS score,
          CAST(deadline AS VARCHAR) AS deadline, labels, fired_rules, quantum_status, c_quantum, x AS x_years FROM verdict""",
    "document_serial": "WITH " + O.COMPONENTS + """
        SELECT scan_id, md5(concat_ws(chr(31), scan_id, count(*), bit_xor(('0x' || substr(bom_ref, 1, 15))::BIGINT), bit_xor(('0x' || substr(bom_ref, 16, 15))::BIGINT))) AS serial
        FROM (SELECT DISTINCT scan_id, bom_ref FROM comp) GROUP BY scan_id""",
    "export_csv": "WITH " + CORRELATED + """
        SELECT scan_id, system, bom_ref, name, string_split(views, ',')[1] AS view, band, CAST(score AS VARCHAR) AS score, usage, endpoint, CAST(deadline AS VARCHAR) AS deadline,
          'false' AS provisional, replace(drift_kinds, ',', ' ') AS drift FROM art""",
    "export_roadmap": "WITH " + O.VERDICT + f"""
        SELECT scan_id, bom_ref, name, usage, band, CAST(score AS VARCHAR) AS score, CAST(deadline AS VARCHAR) AS deadline, CAST(deadline < DATE '{TODAY}' AS VARCHAR) AS overdue,
          'false' AS deadline_provisional, CASE WHEN q_sig THEN 'ML-DSA' WHEN q_kem THEN 'ML-KEM' WHEN q_any THEN 'ML-KEM or ML-DSA' END AS target,
          CASE WHEN hybrid IN ('true', 'false') THEN hybrid END AS hybrid FROM verdict WHERE deadline IS NOT NULL""",
}
ORACLES["kpi_gate"] = f"""SELECT f.recall, f.decoy_hits, d.recall AS drift_recall, d.invented, f.recall >= {kpi.RECALL_GATE} AND f.decoy_hits = 0 AND d.recall = 1 AND d.invented = 0 AS passes
    FROM ({ORACLES["kpi_findings"]}) f, ({ORACLES["kpi_drift"]}) d WHERE f.view = 'OVERALL'"""
ORACLES["combined_scans"] = "WITH " + O.VERDICT + "SELECT 'both' AS scan_id, system, bom_ref, name, CAST(score AS BIGINT) AS base_score FROM verdict"
ORACLES["stream_window"], ORACLES["stream_fates"] = ORACLES["enrich_window"], ORACLES["enrich_fates"]
ORACLES["stream_spool"] = "WITH " + _EVENTS + """
    SELECT 'f' || (event_id // 1000) AS file, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id)::INTEGER AS line_no, CASE WHEN reject_reason IS NULL THEN event_id END AS event_id, reject_reason FROM j"""
ORACLES["stream_counters"] = f"""WITH {_EVENTS}, {_HELD_LINES},
    heirs AS (SELECT DISTINCT holder FROM a WHERE done AND holder IS NOT NULL),
    f AS (SELECT event_id, CASE WHEN full_before AND k > 1 THEN 'orphan' ELSE 'attached' END AS fate FROM r UNION ALL SELECT event_id, 'orphan' FROM a WHERE NOT ret AND holder IS NULL),
    m AS (SELECT e.*, coalesce(v.version, e.version) IS NOT NULL AND coalesce(v.cipher, e.cipher) IS NOT NULL AND coalesce(v.kex, e.kex) IS NOT NULL AND coalesce(v.reads, 0) > 0 AS complete
          FROM e LEFT JOIN v ON v.holder = e.event_id WHERE e.done)
    SELECT (SELECT count(*) FROM j) AS seen, (SELECT count(*) FROM j WHERE reject_reason IS NOT NULL) AS decode_errors, (SELECT count(*) FROM f WHERE fate = 'attached') AS enriched,
      (SELECT count(*) FROM f WHERE fate = 'orphan') AS enrich_orphan, 0::BIGINT AS late,
      (SELECT count(*) FROM m WHERE complete OR event_id NOT IN (SELECT holder FROM heirs)) + (SELECT count(*) FROM e WHERE ret AND NOT done) AS spooled"""

#: What is left of each kind; a text that names a secret also loses the tokens it quotes.
_LEFT = r"""CASE doc_id % 9 WHEN 0 THEN '<redacted key material>' WHEN 1 THEN quiet || chr(10) || 'api_secret = "<redacted>"' WHEN 2 THEN text || chr(10) || 'x <redacted> y'
    WHEN 3 THEN text || chr(10) || 'blob(<redacted>)' WHEN 4 THEN text || chr(10) || '<redacted> end' WHEN 5 THEN text || chr(10) || 'pairs = <redacted>;'
    WHEN 6 THEN quiet || chr(10) || 'DB_PASSWORD=<redacted>' WHEN 7 THEN text || chr(10) || 'pub = ' || to_base64(from_hex({pub})) ELSE 'k = "<redacted>" end' END"""
ORACLES["normalise_redacted"] = r"""WITH d AS (SELECT doc_id, source, lang, text, regexp_replace(text, '(["''`])[0-9a-f]{40}(["''`])', '\1<redacted>\2', 'g') AS quiet FROM documents WHERE text IS NOT NULL),
    x AS (SELECT source AS system, concat('doc/', doc_id, '.py:1') AS locator, """ + _LEFT.replace("{pub}", _PUB_HEX) + r""" AS left_over FROM d)
    SELECT system, locator, md5(left_over) AS snippet, length(left_over) AS length FROM x"""
