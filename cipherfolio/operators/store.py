"""Append-only snapshots: components, drifts, sightings and one summary row.

Every save writes its rows under a version of its own and then publishes that
version in the scan's summary row. Readers only see published versions, so
saving a scan again replaces all of its rows, also those the new save no longer
has, and a save that fails half-way changes nothing a reader sees. Superseded
versions stay on disk; ``superseded`` lists them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherfolio import schema as S
from cipherfolio.knowledge import Pack
from cipherfolio.operators import correlate, metrics, policy

TABLES = ("components", "drifts", "occurrences", "scans")
#: A store without any drift has no drift file to read a schema from.
DRIFTS = (
    "system string, role string, bom_ref string, kind string, declared string, observed string, records bigint, "
    "confidence double, cause string, scan_id string"
)
#: What a component is before any verdict: all a rescore needs.
BASE_COLUMNS = (
    "scan_id", "system", "bom_ref", "asset_type", "primitive", "algorithm", "usage", "locus", "entries", "confidence", "configurable", "n_findings",
    "params", "views", "name", "standard_asset_type", "component_type", "standard_primitive", "crypto_function",
    "nist_quantum_security_level", "classical_security_level",
)


#: Directory columns: the scan as text that no reader takes for a number, and the save's version.
PLACE = ("scan_key", "version")
#: Tasks that share the rows of one scan while it is written, so that a large scan is no single task's work.
SPLITS = 4


def _key(scan_id: Column) -> Column:
    return F.concat(F.lit("k_"), scan_id)


def _write(rows: DataFrame, path: str, version: str) -> None:
    """Clustered by scan and a hash of the artefact: each scan is ``SPLITS`` files, however many tasks made its rows."""
    part = F.pmod(F.xxhash64("bom_ref"), F.lit(SPLITS)) if "bom_ref" in rows.columns else F.lit(0)
    placed = rows.withColumns({"scan_key": _key(F.col("scan_id")), "version": F.lit(version), "_part": part})
    dealt = placed.repartition("scan_key", "_part").drop("_part")
    dealt.write.partitionBy(*PLACE).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    reader = spark.read.schema(f"{DRIFTS}, scan_key string, version string") if name == "drifts" else spark.read
    return reader.parquet(f"{root}/{name}")


def summaries(components: DataFrame, drifts: DataFrame) -> DataFrame:
    """The summary columns of a scan row, from the rows being stored."""
    base = metrics.summarise(components)
    bands = F.create_map(*[part for b in S.BANDS for part in (F.lit(b), F.col(b.lower()))])
    # Five kinds at most, so the map is small.
    kinds = metrics.drift_counts(drifts).groupBy("scan_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "records")))).alias("drift_counts"))
    return base.join(kinds, "scan_id", "left").select(
        "scan_id", "component_count", bands.alias("band_counts"), "max_score",
        F.coalesce("drift_counts", F.create_map().cast("map<string,bigint>")).alias("drift_counts"), "coverage_gaps")


def save_scans(components: DataFrame, drifts: DataFrame, scans: DataFrame, root: str, occurrences: DataFrame | None = None) -> None:
    """Store snapshots. ``scans`` has one row per scan: scan_id, ref, system,
    kind, parent_scan_id, created_at, sector, exposure, z_years, scanners_ran.

    The summary is computed from the rows as written, not from a recomputation.
    """
    spark = components.sparkSession
    version = f"v_{uuid.uuid4().hex}"
    _write(components, f"{root}/components", version)
    _write(drifts, f"{root}/drifts", version)
    if occurrences is not None:
        _write(occurrences, f"{root}/occurrences", version)
    written, found = (_stored(spark, root, name).filter(F.col("version") == version) for name in ("components", "drifts"))
    summary = scans.join(summaries(written, found), "scan_id", "left").withColumns({"scan_key": _key(F.col("scan_id")), "published": F.lit(version)})
    summary.write.partitionBy("scan_key").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/scans")


def read(spark: SparkSession, root: str, name: str, scan_ids: Sequence[str] | None = None) -> DataFrame:
    """The published rows of a stored table, pruned to the partitions of some scans.

    The join with the published versions prunes directories when it runs.
    """
    if name not in TABLES:
        raise ValueError(f"{name!r} is not one of {TABLES}")
    scans = spark.read.parquet(f"{root}/scans")
    if scan_ids is not None:
        scans = scans.filter(F.col("scan_key").isin(*[f"k_{s}" for s in scan_ids]))
    if name == "scans":
        return scans.drop("scan_key", "published")
    rows = _stored(spark, root, name)
    if scan_ids is not None:
        rows = rows.filter(F.col("scan_key").isin(*[f"k_{s}" for s in scan_ids]))
    published = scans.select("scan_key", F.col("published").alias("version"))
    return rows.join(published, list(PLACE), "left_semi").drop(*PLACE)


def superseded(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(scan_key, version) of stored rows that no summary publishes: what a clean-up may delete once no save is running."""
    published = spark.read.parquet(f"{root}/scans").select("scan_key", F.col("published").alias("version"))
    return _stored(spark, root, name).select(*PLACE).distinct().join(published, list(PLACE), "left_anti")


#: What a derived scan inherits, and what holds where neither caller nor parent says.
CONTEXT = {"sector": "other", "exposure": "unknown", "z_years": policy.DEFAULT_Z_YEARS}


def resolve_context(parent: DataFrame, **explicit: object) -> DataFrame:
    """Score inputs of a derived scan: given values, else the parent's, else defaults."""
    rows = parent
    for name, default in CONTEXT.items():
        inherited = F.col(name) if name in parent.columns else F.lit(None)
        rows = rows.withColumn(name, F.lit(explicit[name]) if explicit.get(name) is not None else F.coalesce(inherited, F.lit(default)))
    return rows


def _targets_of(targets: DataFrame, origin: str, context: dict[str, object]) -> DataFrame:
    """One target per system of the origin scan, with sector and exposure as the scan's context has them.

    Targets of other scans are left out; of several rows for a system the least stands.
    """
    own = targets.filter(F.col("scan_id") == origin) if "scan_id" in targets.columns else targets
    said = own.withColumns({name: F.lit(value) for name, value in context.items() if value is not None and name in own.columns})
    columns = [c for c in said.columns if c not in ("scan_id", "system")]
    single = said.groupBy("system").agg(F.min(F.struct(*columns)).alias("_one")) if columns else said.select("system").distinct()
    return single.select(F.lit(origin).alias("scan_id"), "system", *([F.col(f"_one.{c}").alias(c) for c in columns]))


def rescore(spark: SparkSession, root: str, scan_id: str, new_id: str, targets: DataFrame, created_at: object, z_years: int | None = None,
            packs: Sequence[Pack] | None = None, sector: str | None = None, exposure: str | None = None) -> None:
    """Score a stored snapshot again and store the result as its child.

    Works from the base columns of the original scan, so a rescore of a
    rescore never compounds; the parent is not touched. Sector, exposure and
    horizon are the given ones, else the parent's; where the parent has none
    the targets' own stand.
    """
    parent = read(spark, root, "scans", [scan_id])
    context = resolve_context(parent, z_years=z_years, sector=sector, exposure=exposure)
    kind, upper, horizon = context.select("kind", "parent_scan_id", "z_years").first()
    origin = upper if kind == "rescore" and upper else scan_id
    own = parent.select(*[F.col(c) if c in parent.columns else F.lit(None).cast("string").alias(c) for c in ("sector", "exposure")]).first()
    base = read(spark, root, "components", [origin]).select(*BASE_COLUMNS)
    known = {"sector": sector or own["sector"], "exposure": exposure or own["exposure"]}
    scored = policy.score_components(base, _targets_of(targets, origin, known), packs, horizon)
    rows, drifts = correlate.correlate(scored.withColumn("scan_id", F.lit(new_id)))
    save_scans(rows, drifts, _child(context, new_id, origin, "rescore", created_at), root)


def _child(context: DataFrame, new_id: str, parent_id: str, kind: str, created_at: object) -> DataFrame:
    """The summary input of a derived scan; it ran no scanners."""
    return context.select(
        F.lit(new_id).alias("scan_id"), "ref", "system", F.lit(kind).alias("kind"), F.lit(parent_id).alias("parent_scan_id"),
        F.lit(created_at).cast("timestamp").alias("created_at"), "sector", "exposure", "z_years", F.array().cast("array<string>").alias("scanners_ran"))


def save_fix(spark: SparkSession, root: str, scan_id: str, new_id: str, components: DataFrame, drifts: DataFrame, created_at: object,
             occurrences: DataFrame | None = None) -> None:
    """Store what a scan finds after fixes as a child of the scan before them.

    ``components`` and ``drifts`` are the scored rows of the patched files.
    """
    context = resolve_context(read(spark, root, "scans", [scan_id]))
    named = [None if rows is None else rows.withColumn("scan_id", F.lit(new_id)) for rows in (components, drifts, occurrences)]
    save_scans(named[0], named[1], _child(context, new_id, scan_id, "fix", created_at), root, named[2])


def combined(spark: SparkSession, root: str, scan_ids: Sequence[str], new_id: str) -> tuple[DataFrame, DataFrame]:
    """Scored components of several stored scans as one scan, correlated anew: ``(components, drifts)``.

    Nothing is folded: an artefact that several scans hold is a row for each of them, with the verdict that scan gave it.
    """
    return correlate.correlate(read(spark, root, "components", scan_ids).withColumn("scan_id", F.lit(new_id)))


# --- exports ----------------------------------------------------------------

def inventory_export(components: DataFrame, occurrences: DataFrame | None = None) -> DataFrame:
    """The inventory as flat text columns, NULL where there is nothing.

    Places are listed when sightings are given: distinct locators, sorted, in
    one row per component and place so that no cell grows without bound.
    """
    flat = components.select(
        "scan_id", "system", "bom_ref", "name", metrics.first_view().alias("view"), "band", F.col("score").cast("string").alias("score"), "usage",
        F.try_element_at("params", F.lit("endpoint")).alias("endpoint"), F.col("deadline").cast("string").alias("deadline"),
        (F.size("provisional_rules") > 0).cast("string").alias("provisional"), F.array_join("drift_kinds", " ").alias("drift"))
    if occurrences is None:
        return flat
    places = occurrences.select("scan_id", "system", "bom_ref", F.col("locator").alias("location")).distinct()
    return flat.join(places, ["scan_id", "system", "bom_ref"], "left")


def roadmap_export(components: DataFrame, today: str) -> DataFrame:
    rows = metrics.roadmap(components, today)
    return rows.select(
        "scan_id", "bom_ref", "name", "usage", "band", F.col("score").cast("string").alias("score"), F.col("deadline").cast("string").alias("deadline"),
        F.col("overdue").cast("string").alias("overdue"), F.col("deadline_provisional").cast("string").alias("deadline_provisional"), "target",
        F.col("hybrid").cast("string").alias("hybrid"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").option("escape", '"').option("emptyValue", "").option("nullValue", "").mode("overwrite").csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object per line with sorted keys; ``path`` is this export's own, and a retried export replaces itself."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)
