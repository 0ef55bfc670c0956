"""How well an inventory matches an answer key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The gate.
RECALL_GATE = 0.9


def hits_decoy(locator: Column, decoys: Sequence[str]) -> Column:
    """Whether a locator contains any decoy of the answer key."""
    hit = F.lit(False)
    for decoy in decoys:
        hit = hit | F.contains(locator, F.lit(decoy))
    return F.coalesce(hit, F.lit(False))


def planted_found(emitted: DataFrame, planted: DataFrame) -> DataFrame:
    """The answer key with ``found``.

    ``emitted`` has view, algorithm, asset_type, endpoint and locator; it is
    reduced to distinct rows, joined on (view, algorithm) and folded to found
    ids, so what is kept grows with the key and not with the findings.
    """
    seen = emitted.select("view", "algorithm", "asset_type", "endpoint", "locator").distinct()
    key = planted.select(
        "id", "view", "algorithm", F.col("asset_type").alias("want_type"), F.col("endpoint").alias("want_endpoint"), "locator_contains")
    matched = seen.join(key, ["view", "algorithm"]).filter(
        F.contains("locator", F.col("locator_contains"))
        & F.coalesce(F.col("want_type") == F.col("asset_type"), F.col("want_type").isNull())
        & F.coalesce(F.col("want_endpoint") == F.col("endpoint"), F.col("want_endpoint").isNull())
    ).select("id").distinct().withColumn("_hit", F.lit(True))
    return planted.join(matched, "id", "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def finding_scores(emitted: DataFrame, planted: DataFrame, decoys: Sequence[str]) -> DataFrame:
    """Recall per view and overall, and precision overall.

    Known gaps are no part of the denominators. A view of ``OVERALL`` is the
    total over all views.
    """
    graded = planted_found(emitted, planted).filter("NOT known_gap")
    by_view = graded.rollup("view").agg(F.count(F.lit(1)).alias("planted"), F.count_if("found").alias("found"))
    totals = emitted.agg(F.count(F.lit(1)).alias("emitted"), F.count_if(hits_decoy(F.col("locator"), decoys)).alias("decoy_hits"))
    scores = by_view.select(
        F.coalesce("view", F.lit("OVERALL")).alias("view"), "planted", "found",
        F.when(F.col("planted") > 0, F.col("found") / F.col("planted")).otherwise(F.lit(0.0)).alias("recall"))
    # ``totals`` is one row, so this attaches two scalars.
    overall = totals.withColumn("view", F.lit("OVERALL"))
    precision = F.when(F.col("emitted") > 0, (F.col("emitted") - F.col("decoy_hits")) / F.col("emitted")).otherwise(F.lit(0.0))
    joined = scores.join(overall, "view", "left")
    return joined.withColumn("precision", F.when(F.col("emitted").isNotNull(), precision))


def drift_classes(emitted: DataFrame, expected: DataFrame, quiet: DataFrame, limits: DataFrame) -> DataFrame:
    """Every emitted drift as matched, invented, limited or other.

    Quiet endpoints win: any drift on one is invented. A drift that neither
    matches nor sits on a known attribution limit is ``other``.
    """
    wanted = expected.select("kind", "endpoint", F.col("declared").alias("want_declared"), "observed_contains")
    fits = F.coalesce(F.col("want_declared") == F.col("declared"), F.col("want_declared").isNull()) & F.coalesce(
        F.contains("observed", F.col("observed_contains")), F.col("observed_contains").isNull())
    distinct = emitted.groupBy("kind", "endpoint", "declared", "observed").agg(F.sum("records").alias("records"))
    matched = distinct.join(wanted, ["kind", "endpoint"]).filter(fits).select("kind", "endpoint", "declared", "observed").distinct().withColumn("_m", F.lit(True))
    silent = quiet.select("endpoint").distinct().withColumn("_q", F.lit(True))
    whole = limits.filter("kind IS NULL").select("endpoint").distinct().withColumn("_l", F.lit(True))
    part = limits.filter("kind IS NOT NULL").select("endpoint", "kind").distinct().withColumn("_k", F.lit(True))
    rows = (
        distinct.join(matched, ["kind", "endpoint", "declared", "observed"], "left").join(silent, "endpoint", "left")
        .join(whole, "endpoint", "left").join(part, ["endpoint", "kind"], "left")
    )
    return rows.select(
        "kind", "endpoint", "declared", "observed", "records", F.col("_m").isNotNull().alias("matched"), F.col("_q").isNotNull().alias("invented"),
        (F.col("_m").isNull() & (F.col("_l").isNotNull() | F.col("_k").isNotNull())).alias("limited"))


def expected_found(emitted: DataFrame, expected: DataFrame) -> DataFrame:
    distinct = emitted.select("kind", "endpoint", "declared", "observed").distinct()
    wanted = expected.select("id", "kind", "endpoint", F.col("declared").alias("want_declared"), "observed_contains")
    hit = distinct.join(wanted, ["kind", "endpoint"]).filter(
        F.coalesce(F.col("want_declared") == F.col("declared"), F.col("want_declared").isNull())
        & F.coalesce(F.contains("observed", F.col("observed_contains")), F.col("observed_contains").isNull())
    ).select("id").distinct().withColumn("_hit", F.lit(True))
    return expected.join(hit, "id", "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def drift_scores(emitted: DataFrame, expected: DataFrame, quiet: DataFrame, limits: DataFrame) -> DataFrame:
    """One row: drift recall, precision and the counts behind them."""
    classes = drift_classes(emitted, expected, quiet, limits)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("records"))), F.lit(0))

    sums = classes.agg(
        total(F.lit(True)).alias("emitted"), total(F.col("invented")).alias("invented"), total(F.col("limited")).alias("limited")).withColumn("k", F.lit(1))
    recall = expected_found(emitted, expected).agg(F.count(F.lit(1)).alias("expected"), F.count_if("found").alias("found")).withColumn("k", F.lit(1))
    scored = F.col("emitted") - F.col("limited")
    return sums.join(recall, "k").select(
        "expected", "found", "emitted", "invented", "limited",
        F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(F.lit(1.0)).alias("recall"),
        F.when(scored > 0, (scored - F.col("invented")) / scored).otherwise(F.lit(1.0)).alias("precision"))


def passes(finding_row: DataFrame, drift_row: DataFrame) -> DataFrame:
    """The gate over the two score tables."""
    overall = finding_row.filter("view = 'OVERALL'").select("recall", "decoy_hits", F.lit(1).alias("k"))
    drift = drift_row.select(F.col("recall").alias("drift_recall"), "invented", F.lit(1).alias("k"))
    gate = (F.col("recall") >= RECALL_GATE) & (F.col("decoy_hits") == 0) & (F.col("drift_recall") == 1.0) & (F.col("invented") == 0)
    return overall.join(drift, "k").select("recall", "decoy_hits", "drift_recall", "invented", gate.alias("passes"))
