"""Canonicalisation, identity, folding and scoring over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherfolio.functions import canonical as C
from cipherfolio.operators import inventory as inv
from cipherfolio.operators import policy
from cipherfolio.operators.durable import stored
from cipherfolio.plans import oracle_base as O
from cipherfolio.plans import testbed

PARAM_COLUMNS = ("key_size", "curve", "version", "hybrid", "pqc_capable", "group", "endpoint", "role")


def param(name: str, column: str = "params"):
    return F.try_element_at(F.col(column), F.lit(name))


def joined(name: str):
    return F.array_join(F.col(name), ",").alias(name)


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised findings, written once: for queries that fold them to components and to sightings."""
    rows = inv.normalise(testbed.findings(spark, sf_dir))
    return stored(rows.select(*inv.COMPONENT_KEY, *inv.IDENTITY_COLUMNS, "scanner_id", "view", "confidence", "configurable", "occurrences"), "findings")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.build_components(testbed.findings(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, z_years: int | None = None) -> DataFrame:
    return policy.score_components(components(spark, sf_dir), testbed.targets(spark, sf_dir), z_years=z_years)


def canonical_params(spark, sf_dir):
    rows = testbed.findings(spark, sf_dir).select("algorithm", "params", C.canonical_params(F.col("params")).alias("fixed"))
    names = ("key_size", "curve", "version", "hybrid", "pqc_capable")
    return rows.groupBy(
        "algorithm",
        *[param(n).alias(f"raw_{n}") for n in names],
        *[param(n, "fixed").alias(n) for n in names],
    ).agg(F.count(F.lit(1)).alias("n"))


def locator_normalise(spark, sf_dir):
    rows = testbed.findings(spark, sf_dir).select(F.explode("occurrences").alias("o")).select("o.*")
    location, line = C.split_locator(F.col("view"), F.col("locator"))
    return rows.groupBy(
        "view", C.normalise_locator(F.col("view"), F.col("locator")).alias("artefact"),
        location.alias("location"), line.alias("line"),
    ).agg(F.count(F.lit(1)).alias("n"))


def identity_bomref(spark, sf_dir):
    rows = inv.identify(testbed.findings(spark, sf_dir))
    return rows.groupBy("scan_id", "bom_ref").agg(F.count(F.lit(1)).alias("n"))


def dedup_components(spark, sf_dir):
    return components(spark, sf_dir).select(
        "scan_id", "system", "bom_ref", "name", "usage", F.round("confidence", 4).alias("confidence"),
        "configurable", "n_findings", joined("views"),
    )


def sighting_sources(spark, sf_dir):
    rows = inv.sightings(inv.normalise(testbed.findings(spark, sf_dir)))
    return rows.select("scan_id", "bom_ref", "view", "locator", "detail", "snippet", joined("scanners"))


def occurrence_numbers(spark, sf_dir):
    rows = inv.sightings(inv.normalise(testbed.findings(spark, sf_dir)))
    return inv.number_occurrences(rows).select("scan_id", "occurrence_ref", "view", "locator", "detail", "snippet")


def component_levels(spark, sf_dir):
    return components(spark, sf_dir).groupBy(
        "name", "algorithm", "component_type", "standard_asset_type", "standard_primitive", "crypto_function",
        "nist_quantum_security_level", "classical_security_level",
    ).agg(F.count(F.lit(1)).alias("components"))


def validate_rows(spark, sf_dir):
    judged = testbed.damaged_findings(spark, sf_dir).select("scan_id", inv.rejection_reason().alias("reason"))
    return judged.groupBy("scan_id", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def rule_predicates(spark, sf_dir):
    fired = scored(spark, sf_dir).select("scan_id", F.explode("fired_rules").alias("rule"))
    return fired.groupBy("scan_id", "rule").agg(F.count(F.lit(1)).alias("components"))


def policy_verdicts(spark, sf_dir):
    rows = scored(spark, sf_dir)
    category = {c: F.try_element_at("categories", F.lit(c)).alias(f"c_{c}") for c in ("quantum", "mosca", "exposure", "symmetric", "criticality")}
    return rows.select(
        "scan_id", "bom_ref", F.col("score").cast("bigint").alias("score"), "band", joined("labels"),
        F.col("deadline").cast("string").alias("deadline"), joined("fired_rules"), "quantum_status", *category.values(),
    )


def mosca_scores(spark, sf_dir):
    rows = policy.with_score_inputs(components(spark, sf_dir), testbed.targets(spark, sf_dir))
    gap = policy.mosca_gap(F.col("x_years"), F.col("y_years"), F.col("z_years"))
    return rows.groupBy(
        "scan_id", "system", "sector", "exposure", "data_class_name", "x_years", "y_years", "z_years",
        gap.alias("gap"), policy.mosca_contribution(gap, 30).alias("contribution"),
    ).agg(F.count(F.lit(1)).alias("components"))


def horizon_sweep(spark, sf_dir):
    return policy.horizon_sweep(components(spark, sf_dir), testbed.targets(spark, sf_dir))


def band_moves(spark, sf_dir):
    """Components whose band changes between the default horizon and another."""
    inputs = policy.with_score_inputs(components(spark, sf_dir), testbed.targets(spark, sf_dir))
    now = policy.evaluate(inputs).select("scan_id", "bom_ref", F.col("band").alias("old"), *[c for c in inputs.columns if c not in ("scan_id", "bom_ref", "z_years")])
    later = policy.evaluate(now.withColumn("z_years", F.lit(5)))
    return later.groupBy("scan_id", "old", F.col("band").alias("new")).agg(F.count(F.lit(1)).alias("components"))


QUERIES = {
    f.__name__: f
    for f in (
        canonical_params, locator_normalise, identity_bomref, dedup_components, sighting_sources, occurrence_numbers,
        component_levels, validate_rows, rule_predicates, policy_verdicts, mosca_scores, horizon_sweep, band_moves,
    )
}

_NAMES = ("key_size", "curve", "version", "hybrid", "pqc_capable")
ORACLES = {
    "canonical_params": "WITH " + O.IDENTIFIED + f"""
        SELECT c.algorithm, {', '.join(f'w.{n} AS raw_{n}, c.{n} AS {n}' for n in _NAMES)}, count(*) AS n
        FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k FROM wide) w
        JOIN (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k FROM canon) c USING (k)
        GROUP BY ALL""",
    "locator_normalise": "WITH " + O.IDENTIFIED + """
        SELECT view, artefact,
          CASE WHEN view = 'observed' THEN locator ELSE regexp_replace(locator, ':[0-9]+$', '') END AS location,
          CASE WHEN view <> 'observed' THEN CAST(regexp_extract(locator, ':([0-9]+)$', 1) AS BIGINT) END AS line, count(*) AS n
        FROM canon GROUP BY ALL""",
    "identity_bomref": "WITH " + O.IDENTIFIED + "SELECT scan_id, bom_ref, count(*) AS n FROM ident GROUP BY ALL",
    "dedup_components": "WITH " + O.COMPONENTS + """
        SELECT scan_id, system, bom_ref, name, usage, round(confidence, 4) AS confidence, configurable, n_findings, views FROM comp""",
    "sighting_sources": "WITH " + O.IDENTIFIED + """
        SELECT scan_id, bom_ref, view, locator, detail, snippet, array_to_string(list_sort(list(DISTINCT scanner_id)), ',') AS scanners
        FROM ident GROUP BY scan_id, bom_ref, view, locator, detail, snippet""",
    "occurrence_numbers": "WITH " + O.IDENTIFIED + """
        SELECT scan_id, bom_ref || '#' || (row_number() OVER (PARTITION BY scan_id, bom_ref ORDER BY view, locator, detail, snippet) - 1) AS occurrence_ref,
               view, locator, detail, snippet
        FROM (SELECT DISTINCT scan_id, bom_ref, view, locator, detail, snippet FROM ident)""",
    "component_levels": "WITH " + O.COMPONENTS + """
        SELECT name, algorithm, CASE asset_type WHEN 'library' THEN 'library' ELSE 'cryptographic-asset' END AS component_type,
          CASE WHEN asset_type <> 'library' THEN asset_type END AS standard_asset_type,
          CASE WHEN asset_type = 'algorithm' THEN CASE primitive WHEN 'key-agreement' THEN 'key-agree' ELSE primitive END END AS standard_primitive,
          CASE WHEN asset_type = 'algorithm' THEN CASE usage WHEN 'hash' THEN 'digest' WHEN 'key-exchange' THEN 'other'
               WHEN 'key-transport' THEN 'other' WHEN 'unknown' THEN NULL ELSE usage END END AS crypto_function,
          nist_level AS nist_quantum_security_level, classical_level AS classical_security_level, count(*) AS components
        FROM comp GROUP BY ALL""",
    "validate_rows": "WITH " + O.FINDINGS + """
        , kinds AS (SELECT *, (('0x' || substr(md5(system || algorithm || locator || scanner_id), 1, 2))::INTEGER) % 5 AS kind FROM wide)
        SELECT scan_id, 'accepted' AS reason, count(*) AS n FROM wide GROUP BY ALL
        UNION ALL
        SELECT scan_id, ['view','confidence','evidence','confidence','asset_type'][kind + 1] AS reason, count(*) AS n FROM kinds GROUP BY ALL""",
    "rule_predicates": "WITH " + O.VERDICT + """
        SELECT scan_id, rule, count(*) AS components FROM (SELECT scan_id, unnest(string_split(fired_rules, ',')) AS rule FROM verdict) GROUP BY ALL""",
    "policy_verdicts": "WITH " + O.VERDICT + """
        SELECT scan_id, bom_ref, CAST(score AS BIGINT) AS score, band, labels, CAST(deadline AS VARCHAR) AS deadline, fired_rules, quantum_status,
               c_quantum, c_mosca, c_exposure, c_symmetric, c_criticality FROM verdict""",
    "mosca_scores": "WITH " + O.INPUTS + """
        SELECT scan_id, system, sector, exposure, data_class AS data_class_name, x AS x_years, y AS y_years, 11 AS z_years, x + y - 11 AS gap,
               CASE WHEN x IS NULL OR x + y <= 11 THEN 0 ELSE least(30, 30 * (x + y - 11) // 20) END AS contribution, count(*) AS components
        FROM inputs GROUP BY ALL""",
    "horizon_sweep": "WITH " + O.scored("SELECT unnest(generate_series(5, 20)) AS z") + """
        SELECT scan_id, CAST(z AS INTEGER) AS z_years, band, count(*) AS components FROM verdict GROUP BY ALL""",
    "band_moves": "WITH " + O.scored("SELECT unnest([5, 11]) AS z") + """
        SELECT a.scan_id, a.band AS old, b.band AS new, count(*) AS components
        FROM verdict a JOIN verdict b USING (scan_id, bom_ref) WHERE a.z = 11 AND b.z = 5 GROUP BY ALL""",
}
