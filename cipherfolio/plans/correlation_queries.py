"""Cross-view groups, drift, drift effect and snapshot comparison."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from cipherfolio.operators import compare, correlate, metrics, policy
from cipherfolio.operators import inventory as inv
from cipherfolio.operators.durable import durable
from cipherfolio.plans import oracle_base as O
from cipherfolio.plans import testbed
from cipherfolio.plans.inventory_queries import components, joined, scored, settled


def correlate_groups(spark, sf_dir):
    rows = correlate.members(components(spark, sf_dir))
    return correlate.group_views(rows).select(
        *correlate.GROUP, "n_endpoints", "n_declared", "n_shipped", "n_observed", joined("views"), joined("missing"))


def group_coverage(spark, sf_dir):
    rows = correlate.members(components(spark, sf_dir))
    return correlate.coverage(rows).select("scan_id", "system", "bom_ref", joined("coverage_views"), joined("coverage_missing"))


def _drift(spark, sf_dir, kinds):
    found = correlate.drifts_of(correlate.members(components(spark, sf_dir)))
    return found.filter(F.col("kind").isin(*kinds)).select("scan_id", "system", "role", "bom_ref", "kind", "declared", "observed", "records", "confidence")


def drift_evidence(spark, sf_dir):
    findings = settled(spark, sf_dir)
    rows = correlate.members(inv.with_structure(inv.fold_components(findings)))
    return correlate.drift_witnesses(rows, inv.sightings(findings))


def drift_effect(spark, sf_dir):
    rows, _ = correlate.correlate(scored(spark, sf_dir))
    return rows.select(
        "scan_id", "system", "bom_ref", F.col("base_score").cast("bigint").alias("base_score"), F.col("score").cast("bigint").alias("score"),
        "band", "drift_records", joined("drift_kinds"))


def drift_panels(spark, sf_dir):
    rows, found = correlate.correlate(scored(spark, sf_dir))
    return metrics.drift_panels(found, rows)


def drift_counts(spark, sf_dir):
    return metrics.drift_counts(correlate.drifts_of(correlate.members(components(spark, sf_dir))))


def _sides(rows):
    return rows.filter("scan_id = 'base'"), rows.filter("scan_id = 'head'")


def compare_snapshots(spark, sf_dir):
    findings = settled(spark, sf_dir)
    verdicts = policy.score_components(inv.with_structure(inv.fold_components(findings)), testbed.targets(spark, sf_dir))
    changes = compare.evidence_changes_of(inv.sightings(findings), "base", "head")
    rows = compare.compare_components(*_sides(durable(verdicts)), changes)
    return rows.select(
        "system", "bom_ref", "name", "bucket", joined("fields"), "before_band", "after_band",
        F.col("before_score").cast("bigint").alias("before_score"), F.col("after_score").cast("bigint").alias("after_score"),
        "evidence_added", "evidence_removed")


def compare_evidence(spark, sf_dir):
    seen = inv.sightings(inv.normalise(testbed.findings(spark, sf_dir)))
    return compare.evidence_changes_of(seen, "base", "head").select("system", "bom_ref", "view", "locator", "detail", "scanners", "change")


def compare_drift(spark, sf_dir):
    base, head = _sides(correlate.drifts_of(correlate.members(components(spark, sf_dir))))
    return compare.compare_drift(base, head).select("system", "bom_ref", "kind", "declared", "observed", "change")


QUERIES = {
    "correlate_groups": correlate_groups,
    "group_coverage": group_coverage,
    "drift_r1": partial(_drift, kinds=(correlate.SHIPPED_CANNOT,)),
    "drift_r2": partial(_drift, kinds=(correlate.OBSERVED_CLASSICAL, correlate.UNCONFIRMED)),
    "drift_r3": partial(_drift, kinds=(correlate.DOWNGRADE,)),
    "drift_r4": partial(_drift, kinds=(correlate.OUTSIDE_SET,)),
    "drift_evidence": drift_evidence,
    "drift_effect": drift_effect,
    "drift_panels": drift_panels,
    "drift_counts": drift_counts,
    "compare_snapshots": compare_snapshots,
    "compare_evidence": compare_evidence,
    "compare_drift": compare_drift,
}

_RANK = "list_position(['sslv2', 'sslv3', 'tlsv1', 'tlsv1.1', 'tlsv1.2', 'tlsv1.3'], lower(replace(replace(trim({}), 'TLS ', 'TLSv'), '_', '.')))"
_PQ = "regexp_matches(upper({}), 'MLKEM|ML-KEM|KYBER|FRODO|BIKE|HQC')"

GROUPS = """,
mem AS (
  SELECT scan_id, system, bom_ref, name, string_split(views, ',')[1] AS view,
    coalesce(nullif(regexp_replace(regexp_replace(coalesce(role, 'tls'), '-server$', ''), '-client$', ''), ''), 'tls') AS role,
    coalesce(nullif(endpoint, ''), '*') AS endpoint, grp, enrichment, version, pqc_capable, min_version, cipher_suite, cipher_suites,
    CASE hybrid WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE ELSE """ + _PQ.format("coalesce(grp, '') || ' ' || name") + """ END AS is_hybrid
  FROM comp
),
eps AS (SELECT DISTINCT scan_id, system, endpoint FROM mem WHERE endpoint <> '*'),
all_eps AS (
  SELECT * FROM eps UNION ALL
  SELECT DISTINCT scan_id, system, '*' FROM mem WHERE (scan_id, system) NOT IN (SELECT (scan_id, system) FROM eps)
),
groups AS (SELECT scan_id, system, role, endpoint FROM (SELECT DISTINCT scan_id, system, role FROM mem) JOIN all_eps USING (scan_id, system)),
placed AS (
  SELECT g.endpoint AS group_endpoint, m.* FROM groups g
  JOIN mem m ON m.scan_id = g.scan_id AND m.system = g.system AND m.role = g.role AND (m.endpoint = g.endpoint OR m.endpoint = '*')
),
state AS (
  SELECT g.scan_id, g.system, g.role, g.endpoint,
    count(*) FILTER (p.view = 'declared') AS n_declared, count(*) FILTER (p.view = 'shipped') AS n_shipped,
    count(*) FILTER (p.view = 'observed') AS n_observed, coalesce(bool_or(p.endpoint = g.endpoint AND g.endpoint <> '*'), FALSE) AS own
  FROM groups g LEFT JOIN placed p ON p.scan_id = g.scan_id AND p.system = g.system AND p.role = g.role AND p.group_endpoint = g.endpoint
  GROUP BY ALL
),
labelled AS (
  SELECT *, concat_ws(',', CASE WHEN n_declared > 0 THEN 'declared' END, CASE WHEN n_observed > 0 THEN 'observed' END, CASE WHEN n_shipped > 0 THEN 'shipped' END) AS views,
            concat_ws(',', CASE WHEN n_declared = 0 THEN 'declared' END, CASE WHEN n_observed = 0 THEN 'observed' END, CASE WHEN n_shipped = 0 THEN 'shipped' END) AS missing
  FROM state
),
cover AS (
  SELECT p.scan_id, p.system, p.bom_ref, arg_max(l.views, l.endpoint) AS coverage_views, arg_max(l.missing, l.endpoint) AS coverage_missing
  FROM placed p JOIN labelled l ON l.scan_id = p.scan_id AND l.system = p.system AND l.role = p.role AND l.endpoint = p.group_endpoint
  WHERE p.view = 'declared' GROUP BY ALL
)
"""

DRIFT = GROUPS + """,
d AS (SELECT *, coalesce(grp, name) AS wanted, coalesce(min_version, version) AS minimum,
        list_sort(list_distinct(list_filter(list_transform(string_split(cipher_suites, ','), lambda s: trim(s)), lambda s: s <> ''))) AS allowed
      FROM placed WHERE view = 'declared'),
o AS (SELECT * FROM placed WHERE view = 'observed'),
ostate AS (
  SELECT scan_id, system, role, group_endpoint, arg_min(grp, bom_ref) FILTER (grp IS NOT NULL) AS grp,
         bool_or(coalesce(enrichment IN ('partial', 'none'), FALSE)) AS partial
  FROM o GROUP BY ALL
),
records AS (
  SELECT d.scan_id, d.system, d.role, d.bom_ref, 'shipped-cannot-do-declared' AS kind, d.wanted AS declared,
         s.name || ' ' || s.version || ' (not PQC-capable)' AS observed, 1.0 AS confidence
  FROM d JOIN placed s USING (scan_id, system, role, group_endpoint)
  WHERE d.is_hybrid AND s.view = 'shipped' AND s.version <> '' AND s.pqc_capable = 'false'
  UNION ALL
  SELECT d.scan_id, d.system, d.role, d.bom_ref,
         CASE WHEN g.grp IS NOT NULL THEN 'declared-pqc-observed-classical' ELSE 'declared-pqc-observed-unconfirmed' END, d.wanted,
         coalesce(g.grp, 'unconfirmed (group not read)'), CASE WHEN g.grp IS NOT NULL THEN 1.0 ELSE 0.5 END
  FROM d JOIN ostate g USING (scan_id, system, role, group_endpoint)
  WHERE d.is_hybrid AND CASE WHEN g.grp IS NOT NULL THEN NOT """ + _PQ.format("g.grp") + """ ELSE g.partial END
  UNION ALL
  SELECT d.scan_id, d.system, d.role, d.bom_ref, 'protocol-downgrade', d.minimum, o.version, 1.0
  FROM d JOIN o USING (scan_id, system, role, group_endpoint) WHERE """ + _RANK.format("o.version") + " < " + _RANK.format("d.minimum") + """
  UNION ALL
  SELECT d.scan_id, d.system, d.role, d.bom_ref, 'cipher-outside-declared-set', array_to_string(d.allowed, ', '), o.cipher_suite, 1.0
  FROM d JOIN o USING (scan_id, system, role, group_endpoint)
  WHERE len(d.allowed) > 0 AND o.cipher_suite IS NOT NULL AND NOT list_contains(d.allowed, o.cipher_suite)
),
drifts AS (
  SELECT scan_id, system, role, bom_ref, kind, declared, observed, count(*) AS records, CAST(max(confidence) AS DOUBLE) AS confidence
  FROM records GROUP BY ALL
)
"""

#: Ends in ``art``: scored components with drift and coverage applied.
CORRELATED = O.VERDICT + DRIFT + """,
per_comp AS (SELECT scan_id, system, bom_ref, CAST(sum(records) AS BIGINT) AS drift_records, array_to_string(list_sort(list(DISTINCT kind)), ',') AS drift_kinds
             FROM drifts GROUP BY ALL),
raised AS (
  SELECT v.* EXCLUDE (score, band), v.score AS base_score,
    CASE WHEN p.drift_records IS NULL THEN v.score ELSE greatest(60, least(100, CAST(floor(v.score * 1.25 + 0.5) AS INTEGER))) END AS score,
    coalesce(p.drift_records, 0) AS drift_records, coalesce(p.drift_kinds, '') AS drift_kinds,
    c.coverage_views, c.coverage_missing
  FROM verdict v LEFT JOIN per_comp p USING (scan_id, system, bom_ref) LEFT JOIN cover c USING (scan_id, system, bom_ref)
),
art AS (
  SELECT *, CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 60 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS band FROM raised
)
"""

_DRIFT_COLUMNS = "scan_id, system, role, bom_ref, kind, declared, observed, records, confidence"


def _drift_oracle(*kinds: str) -> str:
    return "WITH " + O.COMPONENTS + DRIFT + f"SELECT {_DRIFT_COLUMNS} FROM drifts WHERE kind IN ({', '.join(repr(k) for k in kinds)})"


_ROLE_OF = """CASE WHEN compared_view = '{0}' THEN 'compared' WHEN has_{0} THEN 'not-compared' ELSE 'not-collected' END AS {0}_role"""

ORACLES = {
    "correlate_groups": "WITH " + O.COMPONENTS + GROUPS + """
        SELECT scan_id, system, role, CASE WHEN own THEN endpoint ELSE '*' END AS endpoint, count(*) AS n_endpoints,
               n_declared, n_shipped, n_observed, views, missing FROM labelled GROUP BY ALL""",
    "group_coverage": "WITH " + O.COMPONENTS + GROUPS + "SELECT scan_id, system, bom_ref, coverage_views, coverage_missing FROM cover",
    "drift_r1": _drift_oracle(correlate.SHIPPED_CANNOT),
    "drift_r2": _drift_oracle(correlate.OBSERVED_CLASSICAL, correlate.UNCONFIRMED),
    "drift_r3": _drift_oracle(correlate.DOWNGRADE),
    "drift_r4": _drift_oracle(correlate.OUTSIDE_SET),
    "drift_evidence": "WITH " + O.COMPONENTS + GROUPS + """,
        shown AS (
          SELECT scan_id, system, role, endpoint, bom_ref, 'shipped-cannot-do-declared' AS kind, name || ' ' || version || ' (not PQC-capable)' AS observed
          FROM mem WHERE view = 'shipped' AND version <> '' AND pqc_capable = 'false'
          UNION ALL SELECT scan_id, system, role, endpoint, bom_ref, 'protocol-downgrade', version FROM mem
          WHERE view = 'observed' AND """ + _RANK.format("version") + """ IS NOT NULL
          UNION ALL SELECT scan_id, system, role, endpoint, bom_ref, 'cipher-outside-declared-set', cipher_suite FROM mem
          WHERE view = 'observed' AND cipher_suite <> ''
          UNION ALL SELECT scan_id, system, role, endpoint, bom_ref, 'key-exchange', coalesce(grp, 'unconfirmed (group not read)') FROM mem
          WHERE view = 'observed')
        SELECT DISTINCT s.scan_id, s.system, s.role, s.endpoint, s.kind, s.observed, i.view,
          CASE WHEN i.view = 'observed' THEN locator ELSE regexp_replace(locator, ':[0-9]+$', '') END AS locator,
          CASE WHEN i.view = 'observed' THEN regexp_extract(snippet, '^([^ ]+) via ', 1) END AS peer
        FROM shown s JOIN ident i USING (scan_id, system, bom_ref)""",
    "drift_effect": "WITH " + CORRELATED + """
        SELECT scan_id, system, bom_ref, CAST(base_score AS BIGINT) AS base_score, CAST(score AS BIGINT) AS score, band, drift_records, drift_kinds FROM art""",
    "drift_panels": "WITH " + CORRELATED + """,
        has AS (SELECT scan_id, bool_or(contains(views, 'shipped') OR contains(coalesce(coverage_views, ''), 'shipped')) AS has_shipped,
                  bool_or(contains(views, 'observed') OR contains(coalesce(coverage_views, ''), 'observed')) AS has_observed FROM art GROUP BY ALL),
        panels AS (SELECT scan_id, system, bom_ref, kind, declared, observed, CAST(sum(records) AS BIGINT) AS records, max(confidence) AS c,
                     CASE kind WHEN 'shipped-cannot-do-declared' THEN 'shipped' ELSE 'observed' END AS compared_view FROM drifts GROUP BY ALL)
        SELECT scan_id, system, bom_ref, kind, declared, observed, records, CAST(c * 100 AS INTEGER) AS confidence, compared_view,
          'stated' AS declared_role, """ + _ROLE_OF.format("shipped") + ", " + _ROLE_OF.format("observed") + """,
          CASE WHEN c >= 1 THEN 'verified' ELSE 'provisional' END AS provenance
        FROM panels JOIN has USING (scan_id)""",
    "drift_counts": "WITH " + O.COMPONENTS + DRIFT + "SELECT scan_id, kind, CAST(sum(records) AS BIGINT) AS records FROM drifts GROUP BY ALL",
    "compare_snapshots": "WITH " + O.VERDICT + """,
        b AS (SELECT * FROM verdict WHERE scan_id = 'base'), h AS (SELECT * FROM verdict WHERE scan_id = 'head'),
        ev AS (SELECT DISTINCT scan_id, system, bom_ref, concat_ws('|', view, locator, scanners, detail) AS o FROM
                 (SELECT scan_id, system, bom_ref, view, locator, detail, snippet, array_to_string(list_sort(list(DISTINCT scanner_id)), ',') AS scanners
                  FROM ident GROUP BY scan_id, system, bom_ref, view, locator, detail, snippet)),
        be AS (SELECT system, bom_ref, list(o) AS os FROM ev WHERE scan_id = 'base' GROUP BY ALL),
        he AS (SELECT system, bom_ref, list(o) AS os FROM ev WHERE scan_id = 'head' GROUP BY ALL),
        j AS (SELECT system, bom_ref, coalesce(h.name, b.name) AS name, b.scan_id IS NOT NULL AS was, h.scan_id IS NOT NULL AS is_now,
                b.band AS before_band, h.band AS after_band, CAST(b.score AS BIGINT) AS before_score, CAST(h.score AS BIGINT) AS after_score,
                concat_ws(',', CASE WHEN b.band IS DISTINCT FROM h.band THEN 'band' END, CASE WHEN b.score IS DISTINCT FROM h.score THEN 'score' END,
                  CASE WHEN b.deadline IS DISTINCT FROM h.deadline THEN 'deadline' END,
                  CASE WHEN b.quantum_status IS DISTINCT FROM h.quantum_status THEN 'quantum_status' END,
                  CASE WHEN list_sort(be.os) IS DISTINCT FROM list_sort(he.os) THEN 'evidence' END) AS f,
                len(list_filter(he.os, lambda x: NOT list_contains(be.os, x))) AS added, len(list_filter(be.os, lambda x: NOT list_contains(he.os, x))) AS removed
              FROM b FULL JOIN h USING (system, bom_ref) LEFT JOIN be USING (system, bom_ref) LEFT JOIN he USING (system, bom_ref))
        SELECT system, bom_ref, name, CASE WHEN NOT was THEN 'new' WHEN NOT is_now THEN 'resolved' WHEN f <> '' THEN 'changed' ELSE 'unchanged' END AS bucket,
          CASE WHEN was AND is_now THEN f ELSE '' END AS fields, before_band, after_band, before_score, after_score,
          CASE WHEN was AND is_now THEN added END AS evidence_added, CASE WHEN was AND is_now THEN removed END AS evidence_removed FROM j""",
    "compare_evidence": "WITH " + O.IDENTIFIED + """,
        ev AS (SELECT DISTINCT scan_id, system, bom_ref, view, locator, detail, scanners FROM
                 (SELECT scan_id, system, bom_ref, view, locator, detail, snippet, array_to_string(list_sort(list(DISTINCT scanner_id)), ',') AS scanners
                  FROM ident GROUP BY scan_id, system, bom_ref, view, locator, detail, snippet)),
        b AS (SELECT * EXCLUDE (scan_id) FROM ev WHERE scan_id = 'base'), h AS (SELECT * EXCLUDE (scan_id) FROM ev WHERE scan_id = 'head')
        SELECT *, 'added' AS change FROM (SELECT * FROM h EXCEPT SELECT * FROM b)
        UNION ALL SELECT *, 'removed' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM h)""",
    "compare_drift": "WITH " + O.COMPONENTS + DRIFT + """,
        b AS (SELECT DISTINCT system, bom_ref, kind, declared, observed FROM drifts WHERE scan_id = 'base'),
        h AS (SELECT DISTINCT system, bom_ref, kind, declared, observed FROM drifts WHERE scan_id = 'head')
        SELECT *, 'introduced' AS change FROM (SELECT * FROM h EXCEPT SELECT * FROM b)
        UNION ALL SELECT *, 'resolved' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM h)""",
}
