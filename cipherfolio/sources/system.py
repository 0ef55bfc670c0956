"""Many targets of one system as one set of findings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherfolio import schema as S

#: ``(spark, target) -> DataFrame`` of FINDING rows.
Detector = Callable[[SparkSession, "Target"], DataFrame]


class ManifestError(ValueError):
    """A system manifest names an unknown word or a path nobody can read."""


@dataclass(frozen=True)
class Target:
    kind: str
    ref: str
    system: str


@dataclass(frozen=True)
class Manifest:
    system: str
    sector: str
    exposure: str
    data_class: str | None
    targets: tuple[Target, ...]


def parse_manifest(raw: Mapping[str, Any]) -> Manifest:
    """Words outside the vocabularies are refused, never replaced by a default."""
    system = raw.get("system")
    if not isinstance(system, str) or not system.strip():
        raise ManifestError("a manifest names its system")
    sector, exposure = raw.get("sector", "other"), raw.get("exposure", "unknown")
    if sector not in S.SECTORS:
        raise ManifestError(f"unknown sector {sector!r}")
    if exposure not in S.EXPOSURES:
        raise ManifestError(f"unknown exposure {exposure!r}")
    targets = []
    for entry in raw.get("targets") or ():
        if entry.get("kind") not in S.TARGET_KINDS or not entry.get("ref"):
            raise ManifestError(f"unknown target {entry!r}")
        targets.append(Target(entry["kind"], entry["ref"], system))
    if not targets:
        raise ManifestError("a manifest lists at least one target")
    return Manifest(system, sector, exposure, raw.get("data_class"), tuple(targets))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return bool(location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location))


def check_findings(rows: DataFrame, detector: str) -> DataFrame:
    """The boundary of every detector: exactly the finding columns and types."""
    have = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in S.FINDING.fields}
    if have != want:
        wrong = sorted(n for n in have.keys() | want.keys() if have.get(n) != want.get(n))
        raise TypeError(f"detector {detector!r} returns other columns than findings: {wrong}")
    return rows.select(*S.FINDING_COLUMNS)


def scan_system(spark: SparkSession, manifest: Manifest, detectors: Mapping[str, Sequence[Detector]], scan_id: str) -> tuple[DataFrame, DataFrame]:
    """``(findings of all targets, their one context row)``.

    Fails before anything is read when a target is missing. Findings are
    united first and folded once, so an artefact two targets share is one
    component; the first folder target is the root that paths are relative to.
    """
    missing = [t.ref for t in manifest.targets if not _exists(spark, t.ref)]
    if missing:
        raise ManifestError(f"targets cannot be read: {missing}")
    root = next((t for t in manifest.targets if t.kind in ("repo", "directory")), None)
    parts = [
        check_findings(detect(spark, target), getattr(detect, "__name__", "detector"))
        for target in manifest.targets for detect in detectors.get(target.kind, ())
    ]
    if not parts:
        raise ManifestError("no detector reads these kinds of target")
    rows = reduce(DataFrame.unionByName, parts).withColumn("scan_id", F.lit(scan_id)).withColumn("system", F.lit(manifest.system))
    if root is not None:
        rows = rows.withColumn("target_kind", F.lit(root.kind)).withColumn("target_ref", F.lit(root.ref))
    context = spark.range(1).select(
        F.lit(scan_id).alias("scan_id"), F.lit(manifest.system).alias("system"), F.lit(manifest.data_class).cast("string").alias("data_class"),
        F.lit(manifest.sector).alias("sector"), F.lit(manifest.exposure).alias("exposure"))
    return rows, context
