"""The measures of an inventory, for all scans at once.

Each measure is one grouped aggregate keyed by scan. A value that cannot be
computed is NULL and comes with the reason; it is never a zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherfolio import schema as S
from cipherfolio.operators.inventory import number_within
from cipherfolio.operators.policy import band_rank

BAND_COLUMNS = {band: band.lower() for band in S.BANDS}


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5))


def _param(name: str) -> Column:
    return F.try_element_at(F.col("params"), F.lit(name))


# --- classes of one component -----------------------------------------------

def certainty() -> Column:
    candidate = F.lower(_param("candidate")) == "true"
    return (
        F.when(F.coalesce(candidate, F.lit(False)), F.lit("candidate"))
        .when(F.col("confidence").isNull(), F.lit("unrecorded"))
        .when(F.col("confidence") < 1, F.lit("inferred"))
        .otherwise(F.lit("confirmed"))
    )


def category() -> Column:
    kind = F.col("standard_primitive")
    return (
        F.when(F.col("asset_type") == "protocol", F.lit("proto"))
        .when(kind == "signature", F.lit("sig"))
        .when(kind.isin("kem", "key-agree", "key-agreement", "pke"), F.lit("kex"))
        .when(kind.isin("block-cipher", "stream-cipher", "ae", "mac"), F.lit("sym"))
        .when(kind.isin("hash", "xof", "kdf"), F.lit("hash"))
        .otherwise(F.lit("other"))
    )


def migration_target() -> Column:
    def labelled(label: str) -> Column:
        return F.array_contains("labels", label)

    return (
        F.when(labelled("target-ml-dsa"), F.lit("ML-DSA"))
        .when(labelled("target-ml-kem"), F.lit("ML-KEM"))
        .when(labelled("target-depends-on-usage"), F.lit("ML-KEM or ML-DSA"))
    )


def stated_hybrid() -> Column:
    raw = F.lower(_param("hybrid"))
    return F.when(raw == "true", F.lit(True)).when(raw == "false", F.lit(False))


def first_view() -> Column:
    return F.coalesce(F.get("views", F.lit(0)), F.lit("declared"))


def seen_views() -> Column:
    """The views of the correlation group if known, else the component's own."""
    return F.when(F.size("coverage_views") > 0, F.col("coverage_views")).otherwise(F.col("views"))


# --- summaries --------------------------------------------------------------

def band_counts(components: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("scan_id",)
    return components.groupBy(*keys).agg(*[F.count_if(F.col("band") == b).alias(c) for b, c in BAND_COLUMNS.items()])


def summarise(components: DataFrame) -> DataFrame:
    """Band counts, top score, drift records and coverage gaps per scan."""
    return components.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("component_count"),
        *[F.count_if(F.col("band") == b).alias(c) for b, c in BAND_COLUMNS.items()],
        F.coalesce(F.max("score"), F.lit(0)).alias("max_score"),
        F.sum("drift_records").alias("drift_records"),
        F.count_if(F.coalesce(F.size("coverage_missing"), F.lit(0)) > 0).alias("coverage_gaps"),
    )


def drift_counts(drifts: DataFrame) -> DataFrame:
    """Drift records per scan and kind."""
    return drifts.groupBy("scan_id", "kind").agg(F.sum("records").alias("records"))


def certainty_counts(components: DataFrame) -> DataFrame:
    labelled = components.select("scan_id", certainty().alias("certainty"))
    names = ("candidate", "inferred", "confirmed", "unrecorded")
    return labelled.groupBy("scan_id").agg(*[F.count_if(F.col("certainty") == n).alias(n) for n in names])


def category_band_matrix(components: DataFrame) -> DataFrame:
    return (
        components.select("scan_id", "band", category().alias("category"))
        .groupBy("scan_id", "category").pivot("band", list(S.BANDS)).count()
        .na.fill(0, list(S.BANDS))
        .select("scan_id", "category", *[F.col(b).alias(c) for b, c in BAND_COLUMNS.items()])
    )


def score_histogram(components: DataFrame) -> DataFrame:
    """Ten buckets per scan, empty ones included."""
    bucket = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("score") / 10).cast("int")))
    counted = components.groupBy("scan_id").agg(*[F.count_if(bucket == b).alias(f"b{b}") for b in range(10)])
    rows = F.array(*[F.struct(F.lit(b * 10).alias("floor"), F.col(f"b{b}").alias("components")) for b in range(10)])
    return counted.select("scan_id", F.explode(rows).alias("r")).select("scan_id", "r.floor", "r.components")


def agility(components: DataFrame) -> DataFrame:
    counts = components.groupBy("scan_id").agg(
        F.count_if("configurable").alias("configurable"),
        F.count_if(~F.col("configurable")).alias("hard_coded"),
        F.count_if(F.col("configurable").isNull()).alias("unassessed"),
    )
    assessed = F.col("configurable") + F.col("hard_coded")
    return counts.withColumn("share", percent(F.col("configurable"), assessed)).withColumn(
        "share_reason", F.when(assessed == 0, F.lit("no component carries a configurability finding")))


def quantum_exposure(components: DataFrame) -> DataFrame:
    status = F.col("quantum_status")
    return components.groupBy("scan_id").agg(
        F.count_if(status == "broken").alias("broken"),
        F.count_if(status == "weakened").alias("weakened"),
        F.count_if(status.isNotNull()).alias("assessed"),
        F.count_if(status.isNull()).alias("unassessed"),
    )


def view_coverage(components: DataFrame) -> DataFrame:
    """Per scan and view: how many components were seen in it."""
    seen = seen_views()
    counts = components.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.array_contains(seen, v)).alias(f"n_{v}") for v in S.VIEWS],
        *[F.bool_or(F.array_contains("views", v) | F.coalesce(F.array_contains("coverage_views", v), F.lit(False))).alias(f"has_{v}") for v in S.VIEWS],
    )
    rows = F.array(*[
        F.struct(F.lit(v).alias("view"), F.col(f"n_{v}").alias("seen"), F.col(f"has_{v}").alias("collected")) for v in S.VIEWS
    ])
    return (
        counts.select("scan_id", "total", F.explode(rows).alias("r"))
        .select("scan_id", "r.view", "r.seen", "total", "r.collected", percent(F.col("r.seen"), F.col("total")).alias("percent"))
    )


def drift_headline(components: DataFrame) -> DataFrame:
    """Drift records per scan, or why there is no such number."""
    has = [F.bool_or(F.array_contains("views", v) | F.coalesce(F.array_contains("coverage_views", v), F.lit(False))).alias(v) for v in S.VIEWS]
    counts = components.groupBy("scan_id").agg(F.sum("drift_records").alias("records"), *has)
    collected = F.array_compact(F.array(*[F.when(F.col(v), F.lit(v)) for v in S.VIEWS]))
    reason = F.when(F.size("collected") == 0, F.lit("no view was collected, and drift needs at least two")).when(
        F.size("collected") == 1, F.concat(F.lit("only the "), F.get("collected", F.lit(0)), F.lit(" view was collected, and drift needs at least two")))
    return counts.withColumn("collected", collected).select(
        "scan_id", F.when(F.size("collected") >= 2, F.col("records")).alias("value"), reason.alias("reason"))


def mosca_summary(components: DataFrame) -> DataFrame:
    delta = F.col("z_years") - (F.col("x_years") + F.col("y_years"))
    return components.groupBy("scan_id").agg(
        F.min("x_years").alias("x_min"), F.max("x_years").alias("x_max"),
        F.min("y_years").alias("y_min"), F.max("y_years").alias("y_max"),
        F.max("z_years").alias("z_years"),
        F.min(delta).alias("worst"), F.count_if(delta < 0).alias("exposed"), F.count(delta).alias("assessed"),
    )


def inventory_cards(components: DataFrame, today: str) -> DataFrame:
    cutoff = int(today[:4]) + 2
    return components.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("band").isin("Critical", "High")).alias("severe"),
        F.count_if(F.year("deadline") <= cutoff).alias("due_soon"),
        F.count_if(F.col("deadline").isNotNull()).alias("dated"),
        F.count_if(F.col("drift_records") > 0).alias("drifted"),
    )


def scanner_coverage(components: DataFrame, occurrences: DataFrame, scans: DataFrame) -> DataFrame:
    """Components each recorded scanner contributed to.

    ``scans`` holds scan_id and ``scanners_ran`` (NULL means unknown) and
    ``offered``, the scanners to report on.
    """
    key = ["scan_id", "system", "bom_ref"]
    cited = occurrences.select(*key, F.explode("scanners").alias("scanner")).distinct()
    flags = components.select(*key, (F.size("provisional_rules") > 0).alias("provisional"))
    counts = cited.join(flags, key).groupBy("scan_id", "scanner").agg(
        F.count(F.lit(1)).alias("components"), F.count_if("provisional").alias("provisional"))
    cards = scans.select("scan_id", "scanners_ran", F.explode("offered").alias("scanner"))
    status = F.when(F.col("scanners_ran").isNull(), F.lit("UNKNOWN")).when(
        F.array_contains("scanners_ran", F.col("scanner")), F.lit("SELECTED")).otherwise(F.lit("NOT RUN"))
    return cards.join(counts, ["scan_id", "scanner"], "left").select(
        "scan_id", "scanner", status.alias("status"),
        F.coalesce("components", F.lit(0)).alias("components"), F.coalesce("provisional", F.lit(0)).alias("provisional"))


# --- lists ------------------------------------------------------------------

def risk_order() -> list[Column]:
    """Worst first; a total order."""
    return [F.col("score").desc(), band_rank(F.col("band")).desc(), F.col("name"), F.col("system"), F.col("bom_ref")]


def report_order() -> list[Column]:
    return [band_rank(F.col("band")).desc(), F.col("score").desc(), F.col("name"), F.col("system"), F.col("bom_ref")]


def priority_queue(components: DataFrame, limit: int = 8, by: str = "scan_id") -> DataFrame:
    """The worst components of each scan.

    Spark keeps only ``limit`` rows per scan in every task before it shuffles.
    """
    ranked = components.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*risk_order())))
    return ranked.filter(F.col("position") <= limit)


def worst_by_band(components: DataFrame, limit: int) -> DataFrame:
    """Report grouping: the worst of each populated band."""
    window = Window.partitionBy("scan_id", "band").orderBy(*report_order())
    return components.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= limit)


def inventory_filter(
    components: DataFrame,
    occurrences: DataFrame | None = None,
    bands: Sequence[str] = (),
    views: Sequence[str] = (),
    drift_only: bool = False,
    certainty_class: str | None = None,
    text: str = "",
) -> DataFrame:
    """Narrow the inventory; an empty choice is no constraint."""
    rows = components
    if bands:
        rows = rows.filter(F.col("band").isin(*bands))
    if views:
        rows = rows.filter(first_view().isin(*views))
    if drift_only:
        rows = rows.filter(F.col("drift_records") > 0)
    if certainty_class == "candidates":
        rows = rows.filter(certainty() == "candidate")
    elif certainty_class == "confirmed":
        rows = rows.filter(certainty() != "candidate")
    needle = text.strip().lower()
    if not needle:
        return rows
    own = F.lower(F.concat_ws("\n", "name", "bom_ref", _param("endpoint"), "asset_type", "usage", F.array_join("labels", "\n")))
    here = F.contains(own, F.lit(needle))
    if occurrences is None:
        return rows.filter(here)
    key = ["scan_id", "system", "bom_ref"]
    places = occurrences.filter(F.contains(F.lower("locator"), F.lit(needle))).select(*key).distinct().withColumn("_placed", F.lit(True))
    return rows.join(places, key, "left").filter(here | F.col("_placed").isNotNull()).drop("_placed")


def inventory_sort(components: DataFrame, column: str = "score", descending: bool = True) -> DataFrame:
    primary = {
        "score": F.col("score"),
        "band": band_rank(F.col("band")),
        "deadline": F.coalesce(F.col("deadline").cast("string"), F.lit("9999-12-31")),
        "endpoint": F.coalesce(_param("endpoint"), F.lit("")),
        "view": first_view(),
        "usage": F.col("usage"),
        "name": F.col("name"),
    }[column]
    return components.orderBy(primary.desc() if descending else primary.asc(), "name", "bom_ref")


def roadmap(components: DataFrame, today: str) -> DataFrame:
    """Dated components with their column on the time axis."""
    year = int(today[:4])
    due = F.year("deadline")
    overdue = F.col("deadline") < F.lit(today).cast("date")
    column = (
        F.when(overdue, F.lit("overdue"))
        .when(due <= year, F.lit(str(year)))
        .when(due >= year + 3, F.lit(f"{year + 3}+"))
        .otherwise(due.cast("string"))
    )
    return components.filter(F.col("deadline").isNotNull()).select(
        "scan_id", "system", "bom_ref", "name", "usage", "band", "score", "deadline",
        overdue.alias("overdue"), column.alias("column"), F.col("deadline_provisional"),
        migration_target().alias("target"), stated_hybrid().alias("hybrid"),
    )


def roadmap_clusters(components: DataFrame, today: str) -> DataFrame:
    return roadmap(components, today).groupBy("scan_id", "deadline", "column").agg(
        F.count(F.lit(1)).alias("components"), F.max("score").alias("max_score"))


def drift_panels(drifts: DataFrame, components: DataFrame) -> DataFrame:
    """One panel per disagreement with the role each view plays in it."""
    collected = components.groupBy("scan_id").agg(*[
        F.bool_or(F.array_contains("views", v) | F.coalesce(F.array_contains("coverage_views", v), F.lit(False))).alias(f"has_{v}")
        for v in S.VIEWS])
    compared = F.when(F.col("kind") == "shipped-cannot-do-declared", F.lit("shipped")).otherwise(F.lit("observed"))
    panels = (
        drifts.groupBy("scan_id", "system", "bom_ref", "kind", "declared", "observed")
        .agg(F.sum("records").alias("records"), F.max("confidence").alias("confidence"))
        .withColumn("compared_view", compared)
        .join(collected, "scan_id")
    )

    def role(view: str) -> Column:
        return F.when(F.col("compared_view") == view, F.lit("compared")).when(F.col(f"has_{view}"), F.lit("not-compared")).otherwise(F.lit("not-collected"))

    share = F.floor(F.col("confidence") * 100 + 0.5).cast("int")
    return panels.select(
        "scan_id", "system", "bom_ref", "kind", "declared", "observed", "records", share.alias("confidence"), "compared_view",
        F.lit("stated").alias("declared_role"), role("shipped").alias("shipped_role"), role("observed").alias("observed_role"),
        F.when(share >= 100, F.lit("verified")).otherwise(F.lit("provisional")).alias("provenance"),
    )


# --- scans ------------------------------------------------------------------

def scan_status(scans: DataFrame) -> DataFrame:
    """Status of every stored scan with the reason for it."""
    parent = F.coalesce(F.substring("parent_scan_id", 1, 8), F.lit("an unrecorded scan"))
    status = (
        F.when(F.col("kind") != "scan", F.lit("DERIVED"))
        .when(F.col("scanners_ran").isNull(), F.lit("UNKNOWN"))
        .when((F.size("scanners_ran") == 0) | (F.col("coverage_gaps") > 0), F.lit("PARTIAL"))
        .otherwise(F.lit("COMPLETE"))
    )
    reason = (
        F.when(F.col("kind") != "scan", F.concat(F.lit("a "), F.col("kind"), F.lit(" of "), parent))
        .when(F.col("scanners_ran").isNull(), F.lit("what ran was not recorded"))
        .when(F.size("scanners_ran") == 0, F.lit("no scanner was selected"))
        .when(F.col("coverage_gaps") > 0, F.concat(F.col("coverage_gaps").cast("string"), F.lit(" component(s) miss a view")))
        .otherwise(F.lit("no component misses a view"))
    )
    return scans.withColumn("status", status).withColumn("status_reason", reason)


def risk_trend(scans: DataFrame, last: int = 8) -> DataFrame:
    """Severe components over the last scans of each target."""
    window = Window.partitionBy("ref", "system").orderBy(F.col("created_at").desc(), F.col("scan_id").desc())
    recent = scans.filter("kind = 'scan'").withColumn("age", F.row_number().over(window)).filter(F.col("age") <= last)
    return recent.select("ref", "system", "age", "scan_id", "created_at", (F.col("critical") + F.col("high")).alias("severe"))


def default_comparison(scans: DataFrame) -> DataFrame:
    """The scan each scan is compared with.

    A derived scan compares with its parent. A scan compares with the latest
    earlier one of the same scope. Moments are first reduced to one row each,
    and the lag runs inside (scope, day); only a day's first moment looks at
    the last moment of the scope's previous day, so a scope with a third of
    all scans is still spread over its days.
    """
    scoped = scans.withColumn("scope", F.coalesce("system", "ref"))
    own = F.max(F.when(F.col("kind") == "scan", F.col("scan_id")))
    moments = scoped.groupBy("scope", "created_at").agg(own.alias("latest")).withColumn("day", F.to_date("created_at"))
    in_day = Window.partitionBy("scope", "day").orderBy("created_at").rowsBetween(Window.unboundedPreceding, -1)
    days = moments.groupBy("scope", "day").agg(F.max(F.when(F.col("latest").isNotNull(), F.struct("created_at", "latest"))).alias("last"))
    across = Window.partitionBy("scope").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("scope", "day", F.last(F.col("last.latest"), ignorenulls=True).over(across).alias("carried"))
    before = (
        moments.withColumn("inside", F.last("latest", ignorenulls=True).over(in_day)).join(carried, ["scope", "day"])
        .select("scope", "created_at", F.coalesce("inside", "carried").alias("previous"))
    )
    derived = (F.col("kind") != "scan") & F.col("parent_scan_id").isNotNull()
    return (
        scoped.join(before, ["scope", "created_at"], "left")
        .withColumn("base_scan_id", F.when(derived, F.col("parent_scan_id")).otherwise(F.col("previous")))
        .drop("previous", "scope")
    )


def latest_child(scans: DataFrame) -> DataFrame:
    return scans.filter("parent_scan_id IS NOT NULL").groupBy("parent_scan_id").agg(
        F.max_by("scan_id", F.struct("created_at", "scan_id")).alias("latest_child"), F.count(F.lit(1)).alias("children"))


def scan_page(scans: DataFrame, limit: int = 50, offset: int = 0, kind: str | None = None) -> DataFrame:
    """Newest first; a total order makes paging safe."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("1 <= limit <= 500 and offset >= 0")
    rows = scans.filter(F.col("kind") == kind) if kind else scans
    return rows.orderBy(F.col("created_at").desc(), F.col("scan_id").desc()).offset(offset).limit(limit)


# --- gaps -------------------------------------------------------------------

def worst_gaps(gaps: DataFrame) -> DataFrame:
    """One gap per (scan, scanner, path): unparsed outranks partially-parsed."""
    rank = F.when(F.col("kind") == "unparsed", F.lit(0)).otherwise(F.lit(1))
    return (
        gaps.groupBy("scan_id", "scanner", "path").agg(F.min(F.struct(rank.alias("rank"), "kind", "reason")).alias("g"))
        .select("scan_id", "scanner", "path", "g.kind", "g.reason")
    )


def gap_rollup(gaps: DataFrame, examined: DataFrame) -> DataFrame:
    """Unreadable files per scanner against what it looked at."""
    counts = worst_gaps(gaps).groupBy("scan_id", "scanner").agg(
        F.count_if(F.col("kind") == "unparsed").alias("unparsed"),
        F.count_if(F.col("kind") == "partially-parsed").alias("partially_parsed"),
    )
    return counts.join(examined, ["scan_id", "scanner"], "left").select(
        "scan_id", "scanner", "unparsed", "partially_parsed", F.coalesce("examined", F.lit(0)).alias("examined"),
        ((F.coalesce("examined", F.lit(0)) > 0) & (F.col("unparsed") >= F.coalesce("examined", F.lit(0)))).alias("nothing_parsed"),
    )


def count_scans(scans: DataFrame, kind: str | None = None) -> DataFrame:
    """Rows a listing would page over."""
    rows = scans.filter(F.col("kind") == kind) if kind else scans
    return rows.agg(F.count(F.lit(1)).alias("scans"))


# --- report data ------------------------------------------------------------

def coverage_statement(components: DataFrame, listed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(views, incomplete)``: what was collected, and what lacks a view.

    Every view has a row, collected or not. All components whose group lacks a
    view are named, worst first; a report that shows the first ``listed`` of
    each scan learns from ``remainder`` how many more there are.
    """
    views = view_coverage(components).withColumn("statement", F.when(F.col("collected"), F.lit("COLLECTED")).otherwise(F.lit("NOT COLLECTED")))
    lacking = components.filter(F.size("coverage_missing") > 0)
    totals = lacking.groupBy("scan_id").agg(F.count(F.lit(1)).alias("incomplete"))
    if listed is None:
        # All of a scan: ranked over range slices of the report order, so that no task sorts a whole scan.
        keyed = lacking.withColumn("_band", -band_rank(F.col("band"))).withColumn("_score", -F.col("score"))
        worst = number_within(keyed, ["scan_id"], ["_band", "_score", "name", "system", "bom_ref"], "position").withColumn("position", (F.col("position") + 1).cast("int"))
    else:
        window = Window.partitionBy("scan_id").orderBy(*report_order())
        worst = lacking.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= listed)
    beyond = F.lit(0) if listed is None else F.greatest(F.lit(0), F.col("incomplete") - listed)
    named = worst.join(totals, "scan_id").select(
        "scan_id", "position", "system", "bom_ref", "name", F.array_join("coverage_missing", ", ").alias("missing"),
        beyond.cast("bigint").alias("remainder"))
    return views, named


def drifted(components: DataFrame) -> DataFrame:
    return components.filter(F.col("drift_records") > 0)


def provisional(components: DataFrame) -> DataFrame:
    return components.filter(F.size("provisional_rules") > 0)


def best_place(components: DataFrame, first: DataFrame) -> DataFrame:
    """Where to look first: the endpoint, else the first sighting, else a dash."""
    rows = components.join(first, ["scan_id", "system", "bom_ref"], "left")
    return rows.withColumn("place", F.coalesce(_param("endpoint"), "first_locator", F.lit("-"))).drop("first_view", "first_locator")
