"""Findings -> validated, canonical, content-addressed components.

The component and its sightings are two tables. A component row holds only
fixed-size facts, so an identity reported by a third of all findings is folded
by map-side partial aggregation and never becomes one huge array; sightings
stay one row each in ``occurrences``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherfolio import schema as S
from cipherfolio.functions import canonical as C
from cipherfolio.functions import redact

UNIT = "\u001f"
RECORD = "\u001e"

COMPONENT_KEY = ("scan_id", "system", "bom_ref")
IDENTITY_COLUMNS = ("asset_type", "primitive", "algorithm", "usage", "locus", "entries")


# --- validation -------------------------------------------------------------

def rejection_reason() -> Column:
    """Why a finding must not enter the inventory, NULL when it may."""
    confidence = F.col("confidence")
    first_bad_occurrence = F.exists(
        "occurrences", lambda o: o["view"].isNull() | ~o["view"].isin(*S.VIEWS) | o["locator"].isNull() | o["detail"].isNull()
    )

    def outside(name: str, allowed: tuple[str, ...]) -> Column:
        return F.col(name).isNull() | ~F.col(name).isin(*allowed)

    return (
        F.when(outside("view", S.VIEWS), F.lit("view"))
        .when(outside("asset_type", S.ASSET_TYPES), F.lit("asset_type"))
        .when(outside("primitive", S.PRIMITIVES), F.lit("primitive"))
        .when(outside("usage", S.USAGES), F.lit("usage"))
        .when(F.col("algorithm").isNull() | F.col("scanner_id").isNull(), F.lit("missing"))
        .when(confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1), F.lit("confidence"))
        .when(F.coalesce(F.size("occurrences"), F.lit(0)) < 1, F.lit("evidence"))
        .when(first_bad_occurrence, F.lit("occurrence"))
    )


def split_valid(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected with reason)``: one bad row costs one row.

    The reason is a generated column: a filter on a projected one goes below whatever made the findings, which is then worked
    out for the filter and again for the rows it lets pass.
    """
    judged = findings.select("*", F.explode(F.array(rejection_reason())).alias("reason"))
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


# --- identity ---------------------------------------------------------------

def artefact_locus(scope: Column, occurrences: Column, kind: Column | None = None, ref: Column | None = None) -> Column:
    places = F.transform(occurrences, lambda o: C.normalise_locator(o["view"], o["locator"], kind, ref))
    return F.array_join(F.concat(F.array(scope), F.array_sort(F.array_distinct(places))), UNIT)


def bom_ref(columns: dict[str, Column]) -> Column:
    """128-bit content hash of what identifies an artefact.

    Scanner, view, confidence, configurability, snippet and position are not
    part of it: two detectors that agree must land on one component.
    """
    entries = F.array_join(F.transform(columns["entries"], lambda e: F.concat_ws("=", e["key"], e["value"])), RECORD)
    return F.md5(
        F.concat_ws(
            UNIT,
            columns["algorithm"], columns["asset_type"], columns["locus"], entries,
            columns["primitive"], columns["usage"],
        )
    )


def identify(findings: DataFrame) -> DataFrame:
    """Canonical params, locus and ``bom_ref`` on every finding; a projection.

    ``target_kind`` and ``target_ref`` columns are used when present.
    """
    have = set(findings.columns)
    kind = F.col("target_kind") if "target_kind" in have else None
    ref = F.col("target_ref") if "target_ref" in have else None
    scope = F.coalesce(F.col("system"), ref) if ref is not None else F.col("system")
    staged = (
        findings.withColumn("entries", C.sorted_entries(C.canonical_params(F.coalesce("params", F.create_map().cast("map<string,string>")))))
        .withColumn("locus", artefact_locus(scope, F.col("occurrences"), kind, ref))
    )
    return staged.withColumn("bom_ref", bom_ref({name: F.col(name) for name in IDENTITY_COLUMNS}))


# --- components -------------------------------------------------------------

def component_name(asset_type: Column, algorithm: Column, params: Column) -> Column:
    version = F.try_element_at(params, F.lit("version"))
    curve = F.try_element_at(params, F.lit("curve"))
    size = F.try_element_at(params, F.lit("key_size"))
    numeric = F.when(size.rlike(r"^-?[0-9]+$"), size)
    suffix = F.coalesce(numeric, F.when(curve != "", curve))
    return (
        F.when(asset_type == "protocol", F.when(F.coalesce(version, F.lit("")) != "", F.concat_ws(" ", algorithm, version)).otherwise(algorithm))
        .when(asset_type.isin("library", "module", "service"), algorithm)
        .otherwise(F.concat_ws("-", algorithm, suffix))
    )


def fold_components(identified: DataFrame) -> DataFrame:
    """One row per artefact. One shuffle, all aggregates fixed-size.

    The identifying columns ride in the grouping key: they are determined by
    ``bom_ref``, and keeping the aggregate buffer to numbers and booleans lets
    Spark hash-aggregate on both sides of the shuffle.
    """
    def seen(view: str) -> Column:
        return F.bool_or(F.col("view") == view)

    grouped = identified.groupBy(*COMPONENT_KEY, *IDENTITY_COLUMNS).agg(
        F.max("confidence").alias("confidence"),
        F.bool_and("configurable").alias("all_configurable"),
        F.count(F.lit(1)).alias("n_findings"),
        seen("declared").alias("in_declared"),
        seen("shipped").alias("in_shipped"),
        seen("observed").alias("in_observed"),
    )
    views = F.array_compact(F.array(*[F.when(F.col(f"in_{view}"), F.lit(view)) for view in sorted(S.VIEWS)]))
    params = F.map_from_entries("entries")
    return (
        grouped.withColumn("params", params)
        .withColumn("views", views)
        # bool_and skips NULL: any hard-coded report wins, then configurable, then unknown.
        .withColumnRenamed("all_configurable", "configurable")
        .withColumn("name", component_name(F.col("asset_type"), F.col("algorithm"), F.col("params")))
        .drop("in_declared", "in_shipped", "in_observed")
    )


def sightings(identified: DataFrame) -> DataFrame:
    """Distinct occurrences of each component with the scanners that saw them.

    An outer explode: a plain one has rows filtered by their occurrences first, which works them out three times.
    """
    return (
        identified.select(*COMPONENT_KEY, "scanner_id", F.explode_outer("occurrences").alias("o"))
        .filter("o IS NOT NULL")
        .select(*COMPONENT_KEY, "scanner_id", "o.*")
        .groupBy(*COMPONENT_KEY, "view", "locator", "detail", "snippet")
        .agg(F.array_sort(F.collect_set("scanner_id")).alias("scanners"))
    )


def contributors(identified: DataFrame) -> DataFrame:
    """``(component key, scanners)``: one row for each scanner of a component, without its sightings."""
    seen = identified.filter("scanner_id IS NOT NULL").select(*COMPONENT_KEY, "scanner_id").distinct()
    return seen.select(*COMPONENT_KEY, F.array("scanner_id").alias("scanners"))


def with_location(occurrences: DataFrame) -> DataFrame:
    """Location, line and context the way an inventory document shows them."""
    location, line = C.split_locator(F.col("view"), F.col("locator"))
    return (
        occurrences.withColumn("location", location)
        .withColumn("line", line)
        .withColumn("context", F.when(F.col("snippet").isNull(), F.col("detail")).otherwise(F.concat_ws(" :: ", "detail", "snippet")))
    )


OCCURRENCE_ORDER = ("view", "locator", "detail", "snippet")


def first_sighting(identified: DataFrame) -> DataFrame:
    """``(component key, first)``: the least occurrence, without sorting any group."""
    lowest = F.array_min(F.transform("occurrences", lambda o: F.struct(
        o["view"].alias("view"), o["locator"].alias("locator"), o["detail"].alias("detail"),
        F.coalesce(o["snippet"], F.lit("")).alias("snippet"))))
    return (
        identified.select(*COMPONENT_KEY, lowest.alias("o"))
        .groupBy(*COMPONENT_KEY)
        .agg(F.min("o").alias("o"))
        .select(*COMPONENT_KEY, F.col("o.view").alias("first_view"), F.col("o.locator").alias("first_locator"))
    )


# --- structural facts -------------------------------------------------------

# NIST strength categories by (algorithm, key size).
NIST_CATEGORY = {
    "AES|128": 1,
    "AES|192": 3,
    "AES|256": 5,
    "SHA-256|": 2,
    "SHA3-256|": 2,
    "SHA-384|": 4,
    "SHA3-384|": 4,
}
# Names that meet no category because Shor's algorithm applies.
SHOR_BROKEN = ("RSA", "DSA", "DH", "DHE", "ECDH", "ECDHE", "ECDSA", "EDDSA", "ED25519", "ED448", "ELGAMAL")
# Classical strength, defined for AES only.
CLASSICAL_BITS = {"AES|128": 128, "AES|192": 192, "AES|256": 256}
# Standard spellings of asset types, primitives, functions.
STANDARD_ASSET_TYPE = {
    "algorithm": "algorithm",
    "certificate": "certificate",
    "protocol": "protocol",
    "key": "related-crypto-material",
}
STANDARD_COMPONENT_TYPE = {"library": "library", "module": "library", "service": "application"}
STANDARD_PRIMITIVE = {
    "pke": "pke",
    "signature": "signature",
    "kem": "kem",
    "key-agreement": "key-agree",
    "block-cipher": "block-cipher",
    "stream-cipher": "stream-cipher",
    "hash": "hash",
    "mac": "mac",
    "kdf": "kdf",
    "drbg": "drbg",
    "unknown": "unknown",
}
STANDARD_FUNCTION = {
    "sign": "sign",
    "verify": "verify",
    "encrypt": "encrypt",
    "decrypt": "decrypt",
    "hash": "digest",
    "kdf": "keyderive",
    "key-exchange": "other",
    "key-transport": "other",
}


def numeric_key_size(params: Column) -> Column:
    size = F.try_element_at(params, F.lit("key_size"))
    return F.when(size.rlike(r"^-?[0-9]+$"), size.try_cast("bigint"))


def with_structure(components: DataFrame) -> DataFrame:
    """Standard vocabulary and defined security levels; NULL, never inferred."""
    size = numeric_key_size(F.col("params"))
    pair = F.concat(F.col("algorithm"), F.lit("|"), F.coalesce(size.cast("string"), F.lit("")))
    is_algorithm = F.col("asset_type") == "algorithm"
    broken = F.when(F.upper("algorithm").isin(*SHOR_BROKEN), F.lit(0))
    return (
        components.withColumn("standard_asset_type", C.lookup(STANDARD_ASSET_TYPE, F.col("asset_type")))
        .withColumn("component_type", F.coalesce(C.lookup(STANDARD_COMPONENT_TYPE, F.col("asset_type")), F.lit("cryptographic-asset")))
        .withColumn("standard_primitive", F.when(is_algorithm, C.lookup(STANDARD_PRIMITIVE, F.col("primitive"))))
        .withColumn("crypto_function", F.when(is_algorithm, C.lookup(STANDARD_FUNCTION, F.col("usage"))))
        .withColumn("nist_quantum_security_level", F.when(is_algorithm, F.coalesce(C.lookup(NIST_CATEGORY, pair), broken)))
        .withColumn("classical_security_level", F.when(is_algorithm, C.lookup(CLASSICAL_BITS, pair)))
    )


# The terms the standard document format allows.
MODES = ("cbc", "ecb", "ccm", "gcm", "cfb", "ofb", "ctr", "other", "unknown")
PADDINGS = ("pkcs5", "pkcs7", "pkcs1v15", "oaep", "raw", "other", "unknown")
PROTOCOL_TYPES = ("tls", "ssh", "ipsec", "ike", "sstp", "wpa", "other", "unknown")
MATERIAL_TYPES = (
    "private-key", "public-key", "secret-key", "key", "ciphertext", "signature", "digest",
    "initialization-vector", "nonce", "seed", "salt", "shared-secret", "tag", "additional-data",
    "password", "credential", "token", "other", "unknown",
)


def crypto_properties() -> Column:
    """The type-specific property struct of a component; NULL for containers.

    Key values have no field here on purpose.
    """
    params = F.col("params")

    def param(name: str) -> Column:
        return F.try_element_at(params, F.lit(name))

    def allowed(value: Column, terms: tuple[str, ...]) -> Column:
        return F.when(F.lower(value).isin(*terms), F.lower(value))

    size = numeric_key_size(params)
    kind = F.col("asset_type")
    algorithm = F.struct(
        F.col("standard_primitive").alias("primitive"),
        F.coalesce(size.cast("string"), param("curve")).alias("parameterSetIdentifier"),
        param("curve").alias("curve"),
        allowed(param("mode"), MODES).alias("mode"),
        allowed(param("padding"), PADDINGS).alias("padding"),
        F.when(F.col("crypto_function").isNotNull(), F.array("crypto_function")).alias("cryptoFunctions"),
        F.col("classical_security_level").alias("classicalSecurityLevel"),
        F.col("nist_quantum_security_level").alias("nistQuantumSecurityLevel"),
    )
    certificate = F.struct(
        param("subject").alias("subjectName"),
        param("issuer").alias("issuerName"),
        param("valid_from").try_cast("date").alias("notValidBefore"),
        param("valid_to").try_cast("date").alias("notValidAfter"),
        param("format").alias("certificateFormat"),
        param("extension").alias("certificateExtension"),
    )
    protocol = F.struct(
        F.coalesce(allowed(F.col("algorithm"), PROTOCOL_TYPES), F.lit("other")).alias("type"),
        param("version").alias("version"),
    )
    material = F.struct(
        F.coalesce(allowed(param("material"), MATERIAL_TYPES), F.lit("key")).alias("type"),
        size.alias("size"),
        param("format").alias("format"),
    )
    return F.when(
        F.col("standard_asset_type").isNotNull(),
        F.struct(
            F.col("standard_asset_type").alias("assetType"),
            F.when(kind == "algorithm", algorithm).alias("algorithmProperties"),
            F.when(kind == "certificate", certificate).alias("certificateProperties"),
            F.when(kind == "protocol", protocol).alias("protocolProperties"),
            F.when(kind == "key", material).alias("relatedCryptoMaterialProperties"),
            param("oid").alias("oid"),
        ),
    )


def normalise(findings: DataFrame) -> DataFrame:
    """Findings fit to be stored: validated, without key material in any free text, identified.

    Components and sightings both start here, so neither can hold what the other had removed.
    """
    accepted, _ = split_valid(findings)
    return identify(redact.redact_findings(accepted))


def build_components(findings: DataFrame) -> DataFrame:
    """Findings -> components in one pass: validate, redact, identify, fold, describe."""
    return with_structure(fold_components(normalise(findings)))


# --- numbering --------------------------------------------------------------

def number_within(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """0-based position inside each key group, also for groups no task can hold.

    Rows are range-partitioned on key and order, so one hot group is spread
    over many tasks; each slice is numbered locally and then shifted by the
    sizes of the slices before it. The split is checkpointed because both the
    sizes and the rows must see the same one.
    """
    from cipherfolio.operators.durable import durable

    placed = durable(rows.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    sizes = placed.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_slice", "_local", "_offset")
    )


def number_occurrences(occurrences: DataFrame) -> DataFrame:
    """``<bom_ref>#<n>`` in (view, locator, detail, snippet) order."""
    numbered = number_within(occurrences, list(COMPONENT_KEY), list(OCCURRENCE_ORDER), "n")
    return numbered.withColumn("occurrence_ref", F.concat_ws("#", "bom_ref", F.col("n").cast("string")))
