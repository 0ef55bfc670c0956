"""Cross-view correlation and drift, in space linear in the components.

A member without an endpoint belongs to every endpoint of its system and role.
That over-join is never materialised. What a group holds is summarised twice,
once per concrete endpoint and once per role for the members without one, and
each declared component meets those summaries through equality joins. A drift
row is one distinct disagreement of one component and carries how many records
(component pairs, over all groups) stand behind it; the sightings themselves
stay in ``drift_witnesses``, one row each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherfolio import schema as S
from cipherfolio.functions import canonical as C
from cipherfolio.operators.durable import durable
from cipherfolio.operators.policy import band_of

# Drift kinds, effect, role default.
SHIPPED_CANNOT = "shipped-cannot-do-declared"
OBSERVED_CLASSICAL = "declared-pqc-observed-classical"
UNCONFIRMED = "declared-pqc-observed-unconfirmed"
DOWNGRADE = "protocol-downgrade"
OUTSIDE_SET = "cipher-outside-declared-set"
KINDS = (SHIPPED_CANNOT, OBSERVED_CLASSICAL, UNCONFIRMED, DOWNGRADE, OUTSIDE_SET)
DEFAULT_ROLE = "tls"
ANY = "*"
RISK_FACTOR = 1.25
FLOOR_SCORE = 60
NOT_READ = "unconfirmed (group not read)"
FIRST_CAPABLE = "3.5.0"

SCOPE = ["scan_id", "system"]
ROLE = [*SCOPE, "role"]
GROUP = [*ROLE, "endpoint"]


def _param(name: str) -> Column:
    return F.try_element_at(F.col("params"), F.lit(name))


def _said(name: str) -> Column:
    """A param, with empty text read as absent."""
    return F.when(_param(name) != "", _param(name))


def correlation_role() -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(_param("role"), F.lit(DEFAULT_ROLE)), "-server$", ""), "-client$", "")
    return F.when(bare == "", F.lit(DEFAULT_ROLE)).otherwise(bare)


def members(components: DataFrame, settled: bool = False) -> DataFrame:
    """The correlating part of each component, narrow, with lineage cut.

    Everything below reads these rows several times. ``settled`` components
    come from a stored table or a checkpoint and need no cut of their own.
    """
    name = F.col("name")
    allowed = F.array_distinct(F.filter(F.transform(F.split(_param("cipher_suites"), ","), lambda s: F.trim(s)), lambda s: s != ""))
    rows = components.filter(F.size("views") > 0).select(
        *SCOPE, "bom_ref", "name",
        F.element_at("views", 1).alias("view"),
        correlation_role().alias("role"),
        F.coalesce(_said("endpoint"), F.lit(ANY)).alias("endpoint"),
        C.is_hybrid(F.col("params"), name).alias("hybrid"),
        F.coalesce(_said("group"), name).alias("wanted"),
        _said("group").alias("group"),
        _param("enrichment").alias("enrichment"),
        _said("version").alias("version"),
        F.lower(_param("pqc_capable")).alias("pqc_capable"),
        F.coalesce(_said("min_version"), _said("version")).alias("minimum"),
        _said("cipher_suite").alias("suite"),
        F.when(F.size(allowed) > 0, F.array_sort(allowed)).alias("allowed"),
    )
    known = rows.filter(F.col("view").isin(*S.VIEWS))
    return known if settled else durable(known)


def endpoint_counts(rows: DataFrame) -> DataFrame:
    """Per system: how many groups a role has, and which endpoint sorts last."""
    named = F.when(F.col("endpoint") != ANY, F.col("endpoint"))
    return rows.groupBy(*SCOPE).agg(
        F.greatest(F.count_distinct(named), F.lit(1)).alias("n_groups"),
        F.coalesce(F.max(named), F.lit(ANY)).alias("last_endpoint"),
    )


def group_views(rows: DataFrame) -> DataFrame:
    """Members per view of every group that has a member of its own.

    Each role also gets one ``*`` row for all its other endpoints: they hold
    exactly the role's unplaced members, and ``n_endpoints`` says how many
    such groups there are.
    """
    counts = rows.groupBy(*GROUP).agg(*[F.count_if(F.col("view") == v).alias(v) for v in S.VIEWS])
    unplaced = counts.filter(F.col("endpoint") == ANY).select(*ROLE, *[F.col(v).alias(f"any_{v}") for v in S.VIEWS])
    placed = counts.filter(F.col("endpoint") != ANY)
    roles = (
        counts.groupBy(*ROLE).agg(F.count_if(F.col("endpoint") != ANY).alias("own"))
        .join(endpoint_counts(rows), SCOPE)
        .select(*ROLE, F.lit(ANY).alias("endpoint"), *[F.lit(0).cast("bigint").alias(v) for v in S.VIEWS],
                (F.col("n_groups") - F.col("own")).alias("n_endpoints"))
    )
    groups = placed.withColumn("n_endpoints", F.lit(1).cast("bigint")).unionByName(roles.filter("n_endpoints > 0"))
    merged = groups.join(unplaced, ROLE, "left")
    totals = {v: F.col(v) + F.coalesce(f"any_{v}", F.lit(0)) for v in S.VIEWS}
    present = F.array_compact(F.array(*[F.when(totals[v] > 0, F.lit(v)) for v in sorted(S.VIEWS)]))
    absent = F.array_compact(F.array(*[F.when(totals[v] == 0, F.lit(v)) for v in sorted(S.VIEWS)]))
    return merged.select(
        *GROUP, "n_endpoints", *[t.alias(f"n_{v}") for v, t in totals.items()],
        present.alias("views"), absent.alias("missing"),
    )


def coverage(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``coverage_views`` and ``coverage_missing`` of every declared component.

    A component in several groups reports the last one in endpoint order.
    """
    groups = group_views(rows) if groups is None else groups
    declared = rows.filter(F.col("view") == "declared").join(endpoint_counts(rows), SCOPE)
    placed = declared.select(
        *ROLE, "bom_ref", F.when(F.col("endpoint") == ANY, F.col("last_endpoint")).otherwise(F.col("endpoint")).alias("endpoint")
    )
    own = groups.select(*GROUP, F.col("views").alias("own_views"), F.col("missing").alias("own_missing"))
    rest = groups.filter(F.col("endpoint") == ANY).select(*ROLE, F.col("views").alias("rest_views"), F.col("missing").alias("rest_missing"))
    return placed.join(own, GROUP, "left").join(rest, ROLE, "left").select(
        *SCOPE, "bom_ref",
        F.coalesce("own_views", "rest_views").alias("coverage_views"),
        F.coalesce("own_missing", "rest_missing").alias("coverage_missing"),
    )


# --- witnesses --------------------------------------------------------------

def _witness_rows(rows: DataFrame) -> DataFrame:
    """Every component that can contradict a declaration, with what it shows.

    A component shows at most three things, so the explode is bounded.
    """
    library = (F.col("view") == "shipped") & F.col("version").isNotNull() & (F.col("pqc_capable") == "false")
    observed = F.col("view") == "observed"
    shown = F.array_compact(F.array(
        F.when(library, F.struct(F.lit(SHIPPED_CANNOT).alias("kind"), F.concat(F.col("name"), F.lit(" "), F.col("version"), F.lit(" (not PQC-capable)")).alias("value"))),
        F.when(observed & C.tls_rank(F.col("version")).isNotNull(), F.struct(F.lit(DOWNGRADE).alias("kind"), F.col("version").alias("value"))),
        F.when(observed & F.col("suite").isNotNull(), F.struct(F.lit(OUTSIDE_SET).alias("kind"), F.col("suite").alias("value"))),
    ))
    return rows.select(*GROUP, "bom_ref", F.explode(shown).alias("w")).select(*GROUP, "bom_ref", "w.kind", F.col("w.value").alias("observed"))


def _contradicts() -> Column:
    """Whether a declaration is contradicted by a shown value."""
    kind = F.col("kind")
    return F.coalesce(
        F.when(kind == SHIPPED_CANNOT, F.col("hybrid"))
        .when(kind == DOWNGRADE, C.tls_rank(F.col("observed")) < C.tls_rank(F.col("minimum")))
        .when(kind == OUTSIDE_SET, ~F.array_contains("allowed", F.col("observed"))),
        F.lit(False),
    )


def _declared_text() -> Column:
    return (
        F.when(F.col("kind") == DOWNGRADE, F.col("minimum"))
        .when(F.col("kind") == OUTSIDE_SET, F.array_join("allowed", ", "))
        .otherwise(F.col("wanted"))
    )


def _value_drifts(declared: DataFrame, shown: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rules that compare a declaration with each distinct value shown."""
    per_group = shown.groupBy(*GROUP, "kind", "observed").agg(F.count(F.lit(1)).alias("n"))
    placed = per_group.filter(F.col("endpoint") != ANY)
    unplaced = F.col("endpoint") == ANY
    per_role = per_group.groupBy(*ROLE, "kind", "observed").agg(
        F.sum(F.when(~unplaced, F.col("n")).otherwise(F.lit(0))).alias("n_placed"),
        F.sum(F.when(unplaced, F.col("n")).otherwise(F.lit(0))).alias("n_unplaced"),
    ).join(sizes, SCOPE)

    # A declaration meets only values of a kind it claims something about: at most three claims, and the kind is in the key.
    claimed = F.array_compact(F.array(
        F.when(F.col("hybrid"), F.lit(SHIPPED_CANNOT)), F.when(C.tls_rank(F.col("minimum")).isNotNull(), F.lit(DOWNGRADE)), F.when(F.col("allowed").isNotNull(), F.lit(OUTSIDE_SET))))
    claims = declared.withColumn("kind", F.explode(claimed))
    here = claims.filter(~unplaced).join(placed, [*GROUP, "kind"])
    anywhere = claims.join(per_role, [*ROLE, "kind"]).withColumn(
        "n", F.when(unplaced, F.col("n_placed") + F.col("n_groups") * F.col("n_unplaced")).otherwise(F.col("n_unplaced"))
    ).filter("n > 0")
    columns = [*ROLE, "bom_ref", "kind", _declared_text().alias("declared"), "observed", "n"]
    return here.filter(_contradicts()).select(*columns).unionByName(anywhere.filter(_contradicts()).select(*columns))


def _group_state(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each group observed of its key exchange.

    Returns ``(per concrete endpoint, per role)``. The first group name in
    bom-ref order decides; only when nobody named one does a partial read count.
    """
    per_group = rows.filter(F.col("view") == "observed").groupBy(*GROUP).agg(
        F.min(F.when(F.col("group").isNotNull(), F.struct("bom_ref", "group"))).alias("first"),
        F.max(F.coalesce(F.col("enrichment").isin("partial", "none"), F.lit(False))).alias("partial"),
    )
    unplaced = per_group.filter(F.col("endpoint") == ANY).select(*ROLE, F.col("first").alias("any_first"), F.col("partial").alias("any_partial"))
    states = (
        per_group.filter(F.col("endpoint") != ANY).join(unplaced, ROLE, "left")
        .select(*GROUP, F.least("first", "any_first").alias("first"),
                (F.col("partial") | F.coalesce("any_partial", F.lit(False))).alias("partial"))
    )
    rest = (
        unplaced.join(states.groupBy(*ROLE).agg(F.count(F.lit(1)).alias("own")), ROLE, "left").join(sizes, SCOPE)
        .select(*ROLE, F.col("any_first").alias("first"), F.col("any_partial").alias("partial"),
                (F.col("n_groups") - F.coalesce("own", F.lit(0))).alias("n"))
    )
    return _state_kind(states.withColumn("n", F.lit(1).cast("bigint"))), _state_kind(rest)


def _state_kind(states: DataFrame) -> DataFrame:
    name = F.col("first.group")
    classical = ~F.upper(name).rlike("|".join(C.PQ_MARKERS))
    kind = F.when(name.isNotNull(), F.when(classical, F.lit(OBSERVED_CLASSICAL))).when(F.col("partial"), F.lit(UNCONFIRMED))
    observed = F.when(name.isNotNull(), name).otherwise(F.lit(NOT_READ))
    return states.withColumn("kind", kind).withColumn("observed", observed).drop("first", "partial")


def _exchange_drifts(declared: DataFrame, rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Hybrid declarations against the key exchange actually observed."""
    states, rest = _group_state(rows, sizes)
    hybrid = declared.filter("hybrid")
    at_endpoint = hybrid.filter(F.col("endpoint") != ANY)
    own = states.select(*GROUP, "kind", "observed", "n")
    seen = at_endpoint.join(own, GROUP)
    # An endpoint nobody observed by name sees only the role's unplaced members.
    unseen = at_endpoint.join(own.select(*GROUP), GROUP, "left_anti").join(rest.select(*ROLE, "kind", "observed"), ROLE).withColumn("n", F.lit(1).cast("bigint"))
    every = (
        states.select(*ROLE, "kind", "observed", "n").unionByName(rest.select(*ROLE, "kind", "observed", "n"))
        .groupBy(*ROLE, "kind", "observed").agg(F.sum("n").alias("n"))
    )
    unplaced = hybrid.filter(F.col("endpoint") == ANY).join(every, ROLE)
    columns = [*ROLE, "bom_ref", "kind", F.col("wanted").alias("declared"), "observed", "n"]
    parts = [part.filter("kind IS NOT NULL AND n > 0").select(*columns) for part in (seen, unseen, unplaced)]
    return reduce(DataFrame.unionByName, parts)


def cause_text() -> Column:
    kind, declared, observed = F.col("kind"), F.col("declared"), F.col("observed")
    return (
        F.when(kind == SHIPPED_CANNOT, F.concat(F.lit("the shipped build "), observed, F.lit(" predates "), F.lit(FIRST_CAPABLE), F.lit(", so "), declared, F.lit(" can never be negotiated")))
        .when(kind == OBSERVED_CLASSICAL, F.concat(declared, F.lit(" is configured but handshakes agree on the classical group "), observed))
        .when(kind == UNCONFIRMED, F.concat(declared, F.lit(" is configured; a handshake was seen but its group was not read. This is not evidence of a downgrade")))
        .when(kind == DOWNGRADE, F.concat(F.lit("at least "), declared, F.lit(" is required but "), observed, F.lit(" was negotiated")))
        .otherwise(F.concat(observed, F.lit(" was negotiated and is not among the configured suites")))
    )


def drifts_of(rows: DataFrame) -> DataFrame:
    """Drift rows from ``members``: one per component, kind, declared, observed."""
    sizes = endpoint_counts(rows).select(*SCOPE, "n_groups")
    declared = rows.filter(F.col("view") == "declared").select(*GROUP, "bom_ref", "hybrid", "wanted", "minimum", "allowed")
    found = _value_drifts(declared, _witness_rows(rows), sizes).unionByName(_exchange_drifts(declared, rows, sizes))
    folded = found.groupBy(*ROLE, "bom_ref", "kind", "declared", "observed").agg(F.sum("n").alias("records"))
    return folded.withColumn("confidence", F.when(F.col("kind") == UNCONFIRMED, F.lit(0.5)).otherwise(F.lit(1.0))).withColumn("cause", cause_text())


def drift_witnesses(rows: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Evidence and peers on the contradicting side, one sighting per row.

    Joins a drift on (scan, system, role, kind, observed) and on the endpoint
    where both name one. The exchange kinds cite every observed member.
    """
    exchange = rows.filter(F.col("view") == "observed").select(
        *GROUP, "bom_ref", F.lit("key-exchange").alias("kind"), F.coalesce("group", F.lit(NOT_READ)).alias("observed"))
    shown = _witness_rows(rows).unionByName(exchange)
    context = F.when(F.col("snippet").isNull(), F.col("detail")).otherwise(F.concat_ws(" :: ", "detail", "snippet"))
    peer = F.regexp_extract(context, r"::\s*(\S+)\s+via\s", 1)
    location, _ = C.split_locator(F.col("view"), F.col("locator"))
    cited = occurrences.select(*SCOPE, "bom_ref", "view", location.alias("locator"), F.when(peer != "", peer).alias("peer")).distinct()
    return shown.join(cited, [*SCOPE, "bom_ref"]).select(*GROUP, "kind", "observed", "view", "locator", "peer").distinct()


# --- effect -----------------------------------------------------------------

def raised_score(previous: Column) -> Column:
    return F.greatest(F.lit(FLOOR_SCORE), F.least(F.lit(100), F.floor(previous * RISK_FACTOR + 0.5).cast("int")))


def apply_drift(scored: DataFrame, drifts: DataFrame, covered: DataFrame) -> DataFrame:
    """Write drift and coverage onto scored components.

    ``base_score`` keeps the verdict of the rules; running again starts from it.
    """
    key = [*SCOPE, "bom_ref"]
    counts = drifts.groupBy(*key).agg(
        F.sum("records").alias("drift_records"),
        F.array_sort(F.collect_set("kind")).alias("drift_kinds"),
    )
    base = F.col("base_score") if "base_score" in scored.columns else F.col("score")
    clean = scored.withColumn("base_score", base).drop("drift_records", "drift_kinds", "coverage_views", "coverage_missing")
    # A component may be there once per scan that was combined; what is known of it is the same for all its rows.
    joined = clean.join(counts, key, "left").join(covered.dropDuplicates(key), key, "left")
    drifted = F.col("drift_records").isNotNull()
    score = F.when(drifted, raised_score(F.col("base_score"))).otherwise(F.col("base_score"))
    return (
        joined.withColumn("score", score)
        .withColumn("band", band_of(F.col("score")))
        .withColumn("drift_records", F.coalesce("drift_records", F.lit(0).cast("bigint")))
        .withColumn("drift_kinds", F.coalesce("drift_kinds", F.array().cast("array<string>")))
    )


def correlate(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(components with drift and coverage, drift rows)``.

    The scored components are settled once: they are far fewer than the
    findings, and drift, coverage and the result all read them.
    """
    settled = durable(scored)
    rows = members(settled, settled=True)
    found = drifts_of(rows)
    return apply_drift(settled, found, coverage(rows)), found
