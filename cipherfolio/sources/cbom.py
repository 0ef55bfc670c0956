"""Inventory documents in the standard JSON shape, in and out.

Written documents are directories: one JSON line per component and one per
sighting, range-sorted so that the part files in order are in bom-ref order.
No document has to fit into one task. Reading takes both this form and whole
documents as other tools write them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherfolio.operators import inventory as inv

#: Namespace of the property names in a document; a parameter of the format.
PREFIX = "inventory:"

COMPONENT = """struct<`bom-ref`:string,name:string,type:string,version:string,
  cryptoProperties:struct<assetType:string,oid:string,algorithmProperties:struct<primitive:string,nistQuantumSecurityLevel:int,classicalSecurityLevel:int>>,
  evidence:struct<occurrences:array<struct<location:string,line:bigint,additionalContext:string>>>,
  properties:array<struct<name:string,value:string>>>"""
DOCUMENT = f"struct<serialNumber:string,metadata:struct<component:struct<name:string>,properties:array<struct<name:string,value:string>>>,components:array<{COMPONENT}>>"
BANDS = ("Critical", "High", "Medium", "Low")


# --- out --------------------------------------------------------------------

def _property(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(F.struct(F.lit(PREFIX + name).alias("name"), value.cast("string").alias("value"))))


def _repeated(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(PREFIX + name).alias("name"), v.cast("string").alias("value")))


def component_properties(scored: bool) -> Column:
    """The property bag, sorted by name; repeated names keep their order."""
    entries = F.transform(F.map_entries("params"), lambda e: F.struct(F.concat(F.lit(PREFIX + "param:"), e["key"]).alias("name"), e["value"].alias("value")))
    parts = [
        _property("asset_type", F.col("asset_type")), _property("usage", F.col("usage")), _property("confidence", F.col("confidence")),
        _property("configurable", F.col("configurable")), _repeated("view", F.col("views")), entries,
    ]
    if scored:
        categories = F.transform(F.array_sort(F.map_entries("categories")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
        parts += [
            _property("score", F.col("score")), _property("band", F.col("band")), _property("deadline", F.col("deadline")),
            _property("quantum_status", F.col("quantum_status")), _property("x_years", F.col("x_years")), _property("y_years", F.col("y_years")),
            _property("z_years", F.col("z_years")), _property("sector", F.col("sector")), _property("exposure", F.col("exposure")),
            _property("labels", F.when(F.size("labels") > 0, F.array_join("labels", ","))),
            _property("fired_rules", F.when(F.size("fired_rules") > 0, F.array_join("fired_rules", ","))),
            _repeated("actions", F.col("actions")), _repeated("category_score", categories),
        ]
    bag = F.flatten(F.array_compact(F.array(*parts)))
    # Numbered before sorting by name, so equal names keep their order.
    indexed = F.transform(bag, lambda p, i: F.struct(p["name"].alias("name"), i.alias("at"), p["value"].alias("value")))
    return F.transform(F.array_sort(indexed), lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))


def component_json(components: DataFrame) -> DataFrame:
    """(scan_id, system, bom_ref, json) with one document line per component."""
    scored = "score" in components.columns
    version = F.when(F.col("component_type") != "cryptographic-asset", F.try_element_at("params", F.lit("version")))
    body = F.struct(
        F.col("bom_ref").alias("bom-ref"), F.col("name"), F.col("component_type").alias("type"), version.alias("version"),
        inv.crypto_properties().alias("cryptoProperties"), component_properties(scored).alias("properties"))
    return components.select("scan_id", "system", "bom_ref", F.to_json(body).alias("json"))


def write_document(components: DataFrame, occurrences: DataFrame, path: str) -> None:
    """``path/components`` and ``path/occurrences``, both by scan; writing a scan again replaces its partition."""
    lines = component_json(components).repartitionByRange("scan_id", "bom_ref").sortWithinPartitions("scan_id", "bom_ref")
    lines.select("scan_id", F.col("json").alias("value")).write.partitionBy("scan_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(f"{path}/components")
    seen = inv.with_location(inv.number_occurrences(occurrences))
    body = F.struct(
        F.col("occurrence_ref").alias("bom-ref"), F.col("bom_ref").alias("component"), "view", F.col("locator"), F.array_join("scanners", ",").alias("scanner"),
        "detail", "location", "line", F.col("context").alias("additionalContext"))
    rows = seen.select("scan_id", "bom_ref", "n", F.to_json(body).alias("value")).repartitionByRange("scan_id", "bom_ref", "n").sortWithinPartitions("scan_id", "bom_ref", "n")
    rows.select("scan_id", "value").write.partitionBy("scan_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(f"{path}/occurrences")


def document_serial(components: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """A content hash per scan that needs no ordered list of refs.

    The refs are hashes already; their parts are combined by xor and count,
    which fold map-side. Coverage gaps join the hash only where there are any.
    """
    def part(column: str, start: int) -> Column:
        return F.bit_xor(F.conv(F.substring(column, start, 15), 16, 10).cast("bigint"))

    refs = components.select("scan_id", "bom_ref").distinct()
    folded = refs.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), part("bom_ref", 1).alias("a"), part("bom_ref", 16).alias("b"))
    text = F.concat_ws(inv.UNIT, "scan_id", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    if gaps is None:
        return folded.select("scan_id", F.md5(text).alias("serial"))
    marked = gaps.select("scan_id", F.md5(F.concat_ws(":", "scanner", "kind", "path")).alias("g")).distinct()
    noted = marked.groupBy("scan_id").agg(F.count(F.lit(1)).alias("gap_n"), part("g", 1).alias("ga"), part("g", 16).alias("gb"))
    extra = F.concat_ws(inv.UNIT, F.col("gap_n").cast("string"), F.col("ga").cast("string"), F.col("gb").cast("string"))
    joined = folded.join(noted, "scan_id", "left")
    return joined.select("scan_id", F.md5(F.when(F.col("gap_n").isNull(), text).otherwise(F.concat_ws(inv.UNIT, text, extra))).alias("serial"))


# --- in ---------------------------------------------------------------------

def values(name: str, properties: str = "properties") -> Column:
    """Every value of a repeated property, in document order."""
    return F.transform(F.filter(properties, lambda p: p["name"] == PREFIX + name), lambda p: p["value"])


def value(name: str) -> Column:
    return F.get(values(name), F.lit(0))


def listed(name: str) -> Column:
    """A comma-joined list, trimmed, without empty parts."""
    parts = F.transform(F.split(F.coalesce(value(name), F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def algorithm_of(name: Column, params: Column, asset_type: Column) -> Column:
    """The algorithm behind a component name: the inverse of naming it."""
    def without(separator: str, key: str) -> Column:
        tail = F.concat(F.lit(separator), F.try_element_at(params, F.lit(key)))
        return F.when(F.endswith(name, tail) & (F.length(tail) > 1), F.substr(name, F.lit(1), F.length(name) - F.length(tail)))

    return F.coalesce(
        F.when(asset_type == "protocol", without(" ", "version")),
        F.when(asset_type != "protocol", F.coalesce(without("-", "key_size"), without("-", "curve"))), name)


def typed_components(rows: DataFrame) -> DataFrame:
    """Parsed component structs (column ``c``) to typed inventory rows."""
    keep = [c for c in rows.columns if c != "c"]
    flat = rows.select(*keep, "c.*")
    prefix = PREFIX + "param:"
    params = F.map_from_entries(F.array_distinct(F.transform(
        F.filter("properties", lambda p: F.startswith(p["name"], F.lit(prefix))),
        lambda p: F.struct(F.substr(p["name"], F.lit(len(prefix) + 1)).alias("key"), p["value"].alias("value")))))
    probability = F.trim(value("confidence"))
    confidence = F.when(probability.rlike(r"^\d+(?:\.\d+)?$"), probability.try_cast("double"))
    views = values("view")
    band = value("band")
    typed = flat.select(
        *keep, F.col("bom-ref").alias("bom_ref"), "name", "type", "version",
        F.coalesce(value("asset_type"), F.col("cryptoProperties.assetType"), F.lit("unknown")).alias("asset_type"),
        F.coalesce(value("usage"), F.lit("unknown")).alias("usage"), F.col("cryptoProperties.algorithmProperties.primitive").alias("standard_primitive"),
        F.when(F.size(views) > 0, views).otherwise(F.array(F.lit("declared"))).alias("views"),
        F.when(value("configurable").isNotNull(), value("configurable") == "true").alias("configurable"),
        F.when((confidence >= 0) & (confidence <= 1), confidence).alias("confidence"), params.alias("params"),
        F.when(band.isin(*BANDS), band).otherwise(F.lit("Low")).alias("band"),
        F.coalesce(value("score").try_cast("int"), F.lit(0)).alias("score"), value("deadline").alias("deadline"),
        listed("labels").alias("labels"), listed("fired_rules").alias("fired_rules"), values("actions").alias("actions"),
        F.map_from_entries(F.array_distinct(F.transform(values("category_score"), lambda v: F.struct(
            F.substring_index(v, "=", 1).alias("k"), F.coalesce(F.substring_index(v, "=", -1).try_cast("int"), F.lit(0)).alias("v"))))).alias("categories"),
        value("quantum_status").alias("quantum_status"), listed("coverage:views").alias("coverage_views"), listed("coverage:missing").alias("coverage_missing"),
        *[value(n).try_cast("int").alias(n) for n in ("x_years", "y_years", "z_years")],
        F.arrays_zip(values("drift:kind").alias("kind"), values("drift:declared").alias("declared"), values("drift:observed").alias("observed"),
                     values("drift:cause").alias("cause"), values("drift:confidence").alias("confidence")).alias("drift"),
        values("occurrence").alias("occurrences"), F.col("evidence.occurrences").alias("evidence"),
    )
    return typed.withColumn("algorithm", algorithm_of(F.col("name"), F.col("params"), F.col("asset_type")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents: one row per component."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("document"), F.from_json("value", DOCUMENT).alias("d"))
    rows = raw.select("document", F.coalesce("d.metadata.component.name", F.lit("system")).alias("system"), F.explode("d.components").alias("c"))
    return typed_components(rows)


def read_lines(lines: DataFrame) -> DataFrame:
    """Component lines as ``component_json`` writes them."""
    keep = [c for c in lines.columns if c not in ("json", "bom_ref")]
    return typed_components(lines.select(*keep, F.from_json("json", COMPONENT).alias("c")))


def document_occurrences(components: DataFrame) -> DataFrame:
    """Sightings packed as ``view|locator|scanners|detail``, with their snippet.

    A snippet belongs to the first evidence entry with the same location and,
    where the locator names one, the same line.
    """
    packed = components.select("document", "bom_ref", "evidence", F.explode("occurrences").alias("o"))
    parts = F.split("o", r"\|", 4)
    rows = packed.select("document", "bom_ref", "evidence", F.get(parts, F.lit(0)).alias("view"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("locator"),
                         F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("scanner"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("detail"))
    line = F.regexp_extract("locator", r":(\d+)$", 1).try_cast("bigint")
    place = F.when(line.isNull(), F.col("locator")).otherwise(F.regexp_replace("locator", r":\d+$", ""))
    rows = rows.withColumn("place", place).withColumn("line", line)
    found = F.filter("evidence", lambda e: (e["location"] == F.col("place")) & (F.col("line").isNull() | (e["line"] == F.col("line"))))
    return rows.select("document", "bom_ref", "view", "locator", "scanner", "detail", F.get(found, F.lit(0))["additionalContext"].alias("snippet"))
