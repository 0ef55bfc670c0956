"""Measures, rankings, roadmap and scan history."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherfolio.operators import correlate, metrics, policy
from cipherfolio.operators import inventory as inv
from cipherfolio.plans import oracle_base as O
from cipherfolio.plans import testbed
from cipherfolio.plans.correlation_queries import CORRELATED
from cipherfolio.plans.inventory_queries import joined, scored, settled

TODAY = "2027-06-30"


def artefacts(spark, sf_dir):
    return correlate.correlate(scored(spark, sf_dir))[0]


def sightings(spark, sf_dir):
    return inv.sightings(inv.normalise(testbed.findings(spark, sf_dir)))


def summary_by_scan(spark, sf_dir):
    rows = metrics.summarise(artefacts(spark, sf_dir))
    return rows.withColumn("max_score", F.col("max_score").cast("bigint"))


def band_counts(spark, sf_dir):
    return metrics.band_counts(scored(spark, sf_dir), "scan_id", "system")


def certainty_counts(spark, sf_dir):
    return metrics.certainty_counts(scored(spark, sf_dir))


def category_band_pivot(spark, sf_dir):
    return metrics.category_band_matrix(scored(spark, sf_dir))


def score_histogram(spark, sf_dir):
    return metrics.score_histogram(scored(spark, sf_dir))


def agility(spark, sf_dir):
    return metrics.agility(scored(spark, sf_dir))


def quantum_exposure(spark, sf_dir):
    return metrics.quantum_exposure(scored(spark, sf_dir))


def view_coverage(spark, sf_dir):
    return metrics.view_coverage(artefacts(spark, sf_dir))


def drift_headline(spark, sf_dir):
    return metrics.drift_headline(artefacts(spark, sf_dir))


def mosca_summary(spark, sf_dir):
    return metrics.mosca_summary(scored(spark, sf_dir))


def inventory_cards(spark, sf_dir):
    return metrics.inventory_cards(artefacts(spark, sf_dir), TODAY)


def scanner_coverage(spark, sf_dir):
    scans = testbed.table(spark, sf_dir, "nation").selectExpr("explode(array('base', 'head')) as scan_id").distinct().selectExpr(
        "scan_id",
        "case when scan_id = 'base' then array('source', 'config', 'container', 'runtime-spool') end as scanners_ran",
        "array('source', 'deps', 'container', 'binary', 'config', 'runtime-spool') as offered")
    cited = inv.contributors(inv.normalise(testbed.findings(spark, sf_dir)))
    return metrics.scanner_coverage(scored(spark, sf_dir), cited, scans)


def priority_queue(spark, sf_dir):
    return metrics.priority_queue(scored(spark, sf_dir)).select(
        "scan_id", "position", "system", "bom_ref", "name", F.col("score").cast("bigint").alias("score"), "band")


def worst_by_band(spark, sf_dir):
    return metrics.worst_by_band(scored(spark, sf_dir), 12).select("scan_id", "band", "position", "system", "bom_ref", "name")


def inventory_filter_sort(spark, sf_dir):
    findings = settled(spark, sf_dir)
    verdicts = policy.score_components(inv.with_structure(inv.fold_components(findings)), testbed.targets(spark, sf_dir))
    rows = metrics.inventory_filter(
        correlate.correlate(verdicts)[0], inv.sightings(findings), bands=("Critical", "High"), drift_only=True,
        certainty_class="confirmed", text=" F1.py ")
    return metrics.inventory_sort(rows, "deadline", False).select("scan_id", "system", "bom_ref", "name", "band")


def roadmap(spark, sf_dir):
    rows = metrics.roadmap(scored(spark, sf_dir), TODAY)
    return rows.select("scan_id", "system", "bom_ref", F.col("deadline").cast("string").alias("deadline"), "overdue", "column", "target", "hybrid")


def roadmap_clusters(spark, sf_dir):
    rows = metrics.roadmap_clusters(scored(spark, sf_dir), TODAY)
    return rows.withColumn("deadline", F.col("deadline").cast("string")).withColumn("max_score", F.col("max_score").cast("bigint"))


def coverage_gaps(spark, sf_dir):
    return metrics.gap_rollup(*testbed.page_gaps(spark, sf_dir))


def scan_status(spark, sf_dir):
    return metrics.scan_status(testbed.scans(spark, sf_dir)).select("scan_id", "status", "status_reason")


def risk_trend(spark, sf_dir):
    return metrics.risk_trend(testbed.scans(spark, sf_dir)).select("ref", "system", "age", "scan_id", "severe")


def previous_scan(spark, sf_dir):
    return metrics.default_comparison(testbed.scans(spark, sf_dir)).select("scan_id", "base_scan_id")


def latest_child(spark, sf_dir):
    return metrics.latest_child(testbed.scans(spark, sf_dir))


def scan_page(spark, sf_dir):
    return metrics.scan_page(testbed.scans(spark, sf_dir), 50, 100, "scan").select("scan_id", "kind", "ref")


def count_scans(spark, sf_dir):
    return metrics.count_scans(testbed.scans(spark, sf_dir), "scan")


def coverage_statement(spark, sf_dir):
    return metrics.coverage_statement(artefacts(spark, sf_dir))[1]


def best_place(spark, sf_dir):
    found = inv.identify(testbed.findings(spark, sf_dir))
    rows = metrics.best_place(inv.with_structure(inv.fold_components(found)), inv.first_sighting(found))
    return rows.select("scan_id", "system", "bom_ref", "place")


QUERIES = {
    f.__name__: f
    for f in (
        count_scans, coverage_statement, best_place, summary_by_scan, band_counts, certainty_counts, category_band_pivot, score_histogram, agility, quantum_exposure,
        view_coverage, drift_headline, mosca_summary, inventory_cards, scanner_coverage, priority_queue, worst_by_band,
        inventory_filter_sort, roadmap, roadmap_clusters, coverage_gaps, scan_status, risk_trend, previous_scan,
        latest_child, scan_page,
    )
}

_BANDS = ", ".join(f"count(*) FILTER (band = '{b}') AS {b.lower()}" for b in ("Critical", "High", "Medium", "Low"))
_SCANS = """scans AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS scan_id, 'repo' || (o_custkey % 40) AS ref,
    CASE WHEN o_custkey % 40 < 30 THEN 'sys' || (o_custkey % 40) END AS system,
    CASE WHEN o_orderkey % 4 = 3 THEN 'rescore' WHEN o_orderkey % 16 = 5 THEN 'fix' ELSE 'scan' END AS kind,
    CASE WHEN o_orderkey % 4 = 3 THEN lpad(CAST(o_orderkey - 1 AS VARCHAR), 12, '0') END AS parent_scan_id,
    o_orderdate AS created_at, o_orderkey % 5 AS ran, o_custkey % 7 AS critical, o_orderkey % 5 AS high, o_orderkey % 3 AS gaps
  FROM orders)
"""
_CATEGORY = """CASE WHEN asset_type = 'protocol' THEN 'proto' WHEN asset_type <> 'algorithm' THEN 'other' WHEN primitive = 'signature' THEN 'sig'
  WHEN primitive IN ('kem', 'key-agreement', 'pke') THEN 'kex' WHEN primitive IN ('block-cipher', 'stream-cipher', 'mac') THEN 'sym'
  WHEN primitive IN ('hash', 'kdf') THEN 'hash' ELSE 'other' END"""
_RISK = "score DESC, CASE band WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END DESC, name, system, bom_ref"
_REPORT = "CASE band WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END DESC, score DESC, name, system, bom_ref"
_ROADMAP = f"""deadline < DATE '{TODAY}' AS overdue,
  CASE WHEN deadline < DATE '{TODAY}' THEN 'overdue' WHEN year(deadline) <= 2027 THEN '2027' WHEN year(deadline) >= 2030 THEN '2030+'
       ELSE CAST(year(deadline) AS VARCHAR) END AS "column" """

ORACLES = {
    "count_scans": "WITH " + _SCANS + "SELECT count(*) AS scans FROM scans WHERE kind = 'scan'",
    "coverage_statement": "WITH " + CORRELATED + f""",
        l AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {_REPORT}) AS position, count(*) OVER (PARTITION BY scan_id) AS n FROM art WHERE coverage_missing <> '')
        SELECT scan_id, position, system, bom_ref, name, replace(coverage_missing, ',', ', ') AS missing, 0 AS remainder FROM l""",
    "best_place": "WITH " + O.IDENTIFIED + """
        SELECT scan_id, system, bom_ref, coalesce(any_value(endpoint), arg_min(locator, (view, locator, detail, snippet))) AS place FROM ident GROUP BY scan_id, system, bom_ref""",
    "summary_by_scan": "WITH " + CORRELATED + f"""
        SELECT scan_id, count(*) AS component_count, {_BANDS}, CAST(max(score) AS BIGINT) AS max_score,
          CAST(sum(drift_records) AS BIGINT) AS drift_records, count(*) FILTER (coverage_missing <> '') AS coverage_gaps FROM art GROUP BY ALL""",
    "band_counts": "WITH " + O.VERDICT + f"SELECT scan_id, system, {_BANDS} FROM verdict GROUP BY ALL",
    "certainty_counts": "WITH " + O.COMPONENTS + """
        SELECT scan_id, count(*) FILTER (FALSE) AS candidate, count(*) FILTER (confidence < 1) AS inferred,
          count(*) FILTER (confidence >= 1) AS confirmed, count(*) FILTER (confidence IS NULL) AS unrecorded FROM comp GROUP BY ALL""",
    "category_band_pivot": "WITH " + O.VERDICT + f"SELECT scan_id, {_CATEGORY} AS category, {_BANDS} FROM verdict GROUP BY ALL",
    "score_histogram": "WITH " + O.VERDICT + """
        SELECT s.scan_id, b.floor, count(v.bom_ref) AS components
        FROM (SELECT DISTINCT scan_id FROM verdict) s CROSS JOIN (SELECT unnest(generate_series(0, 90, 10)) AS floor) b
        LEFT JOIN verdict v ON v.scan_id = s.scan_id AND least(90, v.score // 10 * 10) = b.floor GROUP BY ALL""",
    "agility": "WITH " + O.COMPONENTS + """
        SELECT scan_id, count(*) FILTER (configurable) AS configurable, count(*) FILTER (NOT configurable) AS hard_coded,
          count(*) FILTER (configurable IS NULL) AS unassessed,
          CAST(floor(count(*) FILTER (configurable) / count(configurable) * 100 + 0.5) AS BIGINT) AS share, CAST(NULL AS VARCHAR) AS share_reason
        FROM comp GROUP BY ALL""",
    "quantum_exposure": "WITH " + O.VERDICT + """
        SELECT scan_id, count(*) FILTER (quantum_status = 'broken') AS broken, count(*) FILTER (quantum_status = 'weakened') AS weakened,
          count(quantum_status) AS assessed, count(*) FILTER (quantum_status IS NULL) AS unassessed FROM verdict GROUP BY ALL""",
    "view_coverage": "WITH " + CORRELATED + """
        SELECT scan_id, view, count(*) FILTER (contains(CASE WHEN coverage_views <> '' THEN coverage_views ELSE views END, view)) AS seen,
          count(*) AS total, bool_or(contains(views, view) OR contains(coalesce(coverage_views, ''), view)) AS collected,
          CAST(floor(seen / total * 100 + 0.5) AS BIGINT) AS percent
        FROM art CROSS JOIN (SELECT unnest(['declared', 'shipped', 'observed']) AS view) GROUP BY scan_id, view""",
    "drift_headline": "WITH " + CORRELATED + """
        SELECT scan_id, CAST(sum(drift_records) AS BIGINT) AS value, CAST(NULL AS VARCHAR) AS reason FROM art GROUP BY ALL""",
    "mosca_summary": "WITH " + O.VERDICT + """
        SELECT scan_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, CAST(11 AS INTEGER) AS z_years,
          min(11 - x - y) AS worst, count(*) FILTER (x + y > 11) AS exposed, count(x) AS assessed FROM verdict GROUP BY ALL""",
    "inventory_cards": "WITH " + CORRELATED + """
        SELECT scan_id, count(*) AS total, count(*) FILTER (band IN ('Critical', 'High')) AS severe, count(*) FILTER (year(deadline) <= 2029) AS due_soon,
          count(deadline) AS dated, count(*) FILTER (drift_records > 0) AS drifted FROM art GROUP BY ALL""",
    "scanner_coverage": "WITH " + O.IDENTIFIED + """
        SELECT scan_id, scanner, CASE WHEN scan_id = 'head' THEN 'UNKNOWN' WHEN scanner IN ('source', 'config', 'container', 'runtime-spool') THEN 'SELECTED'
          ELSE 'NOT RUN' END AS status, coalesce(components, 0) AS components, CAST(0 AS BIGINT) AS provisional
        FROM (SELECT unnest(['base', 'head']) AS scan_id) CROSS JOIN (SELECT unnest(['source', 'deps', 'container', 'binary', 'config', 'runtime-spool']) AS scanner)
        LEFT JOIN (SELECT scan_id, scanner_id AS scanner, count(DISTINCT (system, bom_ref)) AS components FROM ident GROUP BY ALL) USING (scan_id, scanner)""",
    "priority_queue": "WITH " + O.VERDICT + f"""
        SELECT scan_id, position, system, bom_ref, name, CAST(score AS BIGINT) AS score, band
        FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {_RISK}) AS position FROM verdict) WHERE position <= 8""",
    "worst_by_band": "WITH " + O.VERDICT + f"""
        SELECT scan_id, band, position, system, bom_ref, name
        FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, band ORDER BY {_REPORT}) AS position FROM verdict) WHERE position <= 12""",
    "inventory_filter_sort": "WITH " + CORRELATED + """
        SELECT scan_id, system, bom_ref, name, band FROM art
        WHERE band IN ('Critical', 'High') AND drift_records > 0 AND (
          contains(lower(concat_ws(chr(10), name, bom_ref, endpoint, asset_type, usage, labels)), 'f1.py')
          OR (scan_id, system, bom_ref) IN (SELECT (scan_id, system, bom_ref) FROM ident WHERE contains(lower(locator), 'f1.py')))""",
    "roadmap": "WITH " + O.VERDICT + f"""
        SELECT scan_id, system, bom_ref, CAST(deadline AS VARCHAR) AS deadline, {_ROADMAP},
          CASE WHEN q_sig THEN 'ML-DSA' WHEN q_kem THEN 'ML-KEM' WHEN q_any THEN 'ML-KEM or ML-DSA' END AS target,
          CASE hybrid WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS hybrid
        FROM verdict WHERE deadline IS NOT NULL""",
    "roadmap_clusters": "WITH " + O.VERDICT + f"""
        SELECT scan_id, CAST(deadline AS VARCHAR) AS deadline, "column", count(*) AS components, CAST(max(score) AS BIGINT) AS max_score
        FROM (SELECT *, {_ROADMAP} FROM verdict WHERE deadline IS NOT NULL) GROUP BY ALL""",
    "coverage_gaps": """WITH p AS (
          SELECT 'base' AS scan_id, ['source', 'config', 'deps'][page_id % 3 + 1] AS scanner, url AS path,
            (length(html) - length(replace(html, '<p>', ''))) * 4 AS opened, (length(html) - length(replace(html, '</p>', ''))) * 3 AS closed FROM pages),
        g AS (SELECT scan_id, scanner, path, bool_or(closed > opened) AS unparsed FROM p WHERE opened <> closed GROUP BY ALL)
        SELECT scan_id, scanner, count(*) FILTER (unparsed) AS unparsed, count(*) FILTER (NOT unparsed) AS partially_parsed, max(examined) AS examined,
          count(*) FILTER (unparsed) >= max(examined) AS nothing_parsed
        FROM g JOIN (SELECT scanner, count(DISTINCT path) AS examined FROM p GROUP BY ALL) USING (scanner) GROUP BY scan_id, scanner""",
    "scan_status": "WITH " + _SCANS + """
        SELECT scan_id, CASE WHEN kind <> 'scan' THEN 'DERIVED' WHEN ran = 0 THEN 'UNKNOWN' WHEN ran = 1 OR gaps > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status,
          CASE WHEN kind <> 'scan' THEN 'a ' || kind || ' of ' || coalesce(left(parent_scan_id, 8), 'an unrecorded scan') WHEN ran = 0 THEN 'what ran was not recorded'
            WHEN ran = 1 THEN 'no scanner was selected' WHEN gaps > 0 THEN gaps || ' component(s) miss a view' ELSE 'no component misses a view' END AS status_reason
        FROM scans""",
    "risk_trend": "WITH " + _SCANS + """
        SELECT ref, system, age, scan_id, severe FROM (
          SELECT *, critical + high AS severe, row_number() OVER (PARTITION BY ref, system ORDER BY created_at DESC, scan_id DESC) AS age FROM scans WHERE kind = 'scan')
        WHERE age <= 8""",
    "previous_scan": "WITH " + _SCANS + """,
        scoped AS (SELECT *, coalesce(system, ref) AS scope FROM scans),
        m AS (SELECT scope, created_at, max(scan_id) AS latest FROM scoped WHERE kind = 'scan' GROUP BY ALL)
        SELECT scan_id, CASE WHEN kind <> 'scan' AND parent_scan_id IS NOT NULL THEN parent_scan_id
          ELSE (SELECT arg_max(latest, m.created_at) FROM m WHERE m.scope = s.scope AND m.created_at < s.created_at) END AS base_scan_id
        FROM scoped s""",
    "latest_child": "WITH " + _SCANS + """
        SELECT parent_scan_id, arg_max(scan_id, (created_at, scan_id)) AS latest_child, count(*) AS children FROM scans WHERE parent_scan_id IS NOT NULL GROUP BY ALL""",
    "scan_page": "WITH " + _SCANS + "SELECT scan_id, kind, ref FROM scans WHERE kind = 'scan' ORDER BY created_at DESC, scan_id DESC LIMIT 50 OFFSET 100",
}
