"""Differences between two stored snapshots, keyed by bom-ref."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The verdict fields a change reports, in report order.
VERDICT_FIELDS = ("band", "score", "deadline", "quantum_status")
KEY = ["system", "bom_ref"]


def evidence_changes(base_occurrences: DataFrame, head_occurrences: DataFrame) -> DataFrame:
    """Sightings present on one side only, one row each."""
    return _one_sided(base_occurrences.withColumn("side", F.lit(1)).unionByName(head_occurrences.withColumn("side", F.lit(2))))


def evidence_changes_of(occurrences: DataFrame, base: str, head: str) -> DataFrame:
    """The same for two scans of one table of sightings, which is read once."""
    side = F.when(F.col("scan_id") == base, F.lit(1)).otherwise(F.lit(2))
    return _one_sided(occurrences.filter(F.col("scan_id").isin(base, head)).withColumn("side", side))


def _one_sided(sided: DataFrame) -> DataFrame:
    key = [*KEY, "view", "locator", "detail", "scanners"]
    merged = sided.withColumn("scanners", F.array_join("scanners", ",")).groupBy(*key).agg(F.bit_or("side").alias("sides"))
    change = F.when(F.col("sides") == 2, F.lit("added")).when(F.col("sides") == 1, F.lit("removed"))
    return merged.withColumn("change", change).filter("change IS NOT NULL").drop("sides")


def compare_components(base: DataFrame, head: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One row per bom-ref of either side with its bucket and changed fields.

    One full outer join on the content hash; ``evidence`` is folded to two
    counts per component before it is joined.
    """
    def side(rows: DataFrame, prefix: str) -> DataFrame:
        fields = [F.col(f).alias(f"{prefix}_{f}") for f in VERDICT_FIELDS]
        return rows.select(*KEY, F.col("name").alias(f"{prefix}_name"), *fields, F.lit(True).alias(f"{prefix}_present"))

    joined = side(base, "before").join(side(head, "after"), KEY, "full_outer")
    if evidence is not None:
        counts = evidence.groupBy(*KEY).agg(
            F.count_if(F.col("change") == "added").alias("evidence_added"),
            F.count_if(F.col("change") == "removed").alias("evidence_removed"),
        )
        joined = joined.join(counts, KEY, "left")
    else:
        joined = joined.withColumn("evidence_added", F.lit(0).cast("bigint")).withColumn("evidence_removed", F.lit(0).cast("bigint"))
    added, removed = F.coalesce("evidence_added", F.lit(0)), F.coalesce("evidence_removed", F.lit(0))

    def differs(name: str) -> Column:
        return ~F.col(f"before_{name}").eqNullSafe(F.col(f"after_{name}"))

    fields = F.array_compact(F.array(
        *[F.when(differs(f), F.lit(f)) for f in VERDICT_FIELDS],
        F.when(added + removed > 0, F.lit("evidence")),
    ))
    both = F.col("before_present").isNotNull() & F.col("after_present").isNotNull()
    bucket = (
        F.when(F.col("before_present").isNull(), F.lit("new"))
        .when(F.col("after_present").isNull(), F.lit("resolved"))
        .when(F.size("fields") > 0, F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    return (
        joined.withColumn("fields", F.when(both, fields).otherwise(F.array().cast("array<string>")))
        .withColumn("bucket", bucket)
        .withColumn("evidence_added", F.when(both, added))
        .withColumn("evidence_removed", F.when(both, removed))
        .withColumn("name", F.coalesce("after_name", "before_name"))
        .drop("before_present", "after_present", "before_name", "after_name")
    )


def compare_drift(base: DataFrame, head: DataFrame) -> DataFrame:
    """Disagreements on one side only; witnesses of the same one collapse."""
    key = [*KEY, "kind", "declared", "observed"]
    sides = [
        rows.groupBy(*key).agg(F.min("cause").alias("cause")).withColumn("side", F.lit(side))
        for rows, side in ((base, 1), (head, 2))
    ]
    merged = sides[0].unionByName(sides[1]).groupBy(*key).agg(F.sum("side").alias("sides"), F.min("cause").alias("cause"))
    change = F.when(F.col("sides") == 2, F.lit("introduced")).when(F.col("sides") == 1, F.lit("resolved"))
    return merged.withColumn("change", change).filter("change IS NOT NULL").drop("sides")


def arrivals(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Findings present after a change and not before it."""
    return after.join(before.select(*key).distinct(), key, "left_anti")


def survivors(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Findings a change was meant to remove that are still there."""
    return before.join(after.select(*key).distinct(), key, "left_semi")
