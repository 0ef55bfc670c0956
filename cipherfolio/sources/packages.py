"""Installed packages and declared dependencies as library findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherfolio.knowledge import HERE, read_table
from cipherfolio.sources import files as T

# Lockfiles and manifests, most certain first.
MANIFESTS = {
    "pypi": ("poetry.lock", "Pipfile.lock", "requirements.txt", "pyproject.toml"),
    "npm": ("package-lock.json", "yarn.lock", "package.json"),
    "go": ("go.mod", "go.sum"),
}
RANGE_CONFIDENCE = 0.7
RANGE_NOTE = "a range; no lockfile resolves it, so the installed version is not known"


def upstream_version(raw: Column) -> Column:
    """A version without its leading v, epoch, packaging revision and build."""
    bare = F.regexp_replace(F.btrim(raw, F.lit(" \t\n\r")), r"^[vV](?=[0-9])", "")
    epoch = F.substring_index(bare, ":", -1)
    return F.substring_index(F.substring_index(F.when(epoch != "", epoch).otherwise(bare), "-", 1), "+", 1)


def version_array(version: Column) -> Column:
    """Leading numbers of each part, cut at the first part without one."""
    numbers = F.transform(F.split(upstream_version(version), r"\."), lambda p: F.regexp_extract(p, r"^\d+", 0))
    bad = F.array_position(numbers, "")
    kept = F.when(bad > 0, F.slice(numbers, F.lit(1), (bad - 1).cast("int"))).otherwise(numbers)
    return F.transform(kept, lambda n: n.cast("bigint"))


def is_pqc_capable(floor: Column, verified: Column, version: Column) -> Column:
    """NULL without a confirmed floor: unknown is not incapable."""
    return F.when(floor.isNotNull() & F.coalesce(verified, F.lit(False)), version_array(version) >= version_array(floor))


def libraries(spark: SparkSession, entries: list[dict] | None = None) -> DataFrame:
    """(ecosystem, package, library, floor, verified), one row per package name."""
    entries = read_table(HERE / "libraries.toml")["libraries"] if entries is None else entries
    rows = [
        (e.get("ecosystem", "distro"), p.lower(), e["name"], e.get("pqc_capable_from"), bool(e.get("pqc_capable_verified", False)), e.get("eol"))
        for e in entries for p in e.get("packages", ())
    ]
    return spark.createDataFrame(rows, "ecosystem string, package_key string, library string, floor string, verified boolean, eol string")


def join_libraries(packages: DataFrame, facts: DataFrame) -> DataFrame:
    """Packages that ship a known library, never across ecosystems.

    The fact table normally comes from the knowledge file: tens of rows.
    """
    keyed = packages.withColumn("package_key", F.lower("package"))
    return keyed.join(facts, ["ecosystem", "package_key"]).drop("package_key")


def package_findings(packages: DataFrame, facts: DataFrame, detail: Column, view: str = "shipped", scanner: str = "container") -> DataFrame:
    """Needs scan_id, system, path, ecosystem, package, version and source."""
    rows = join_libraries(packages, facts).withColumn("upstream", upstream_version(F.col("version")))
    capable = is_pqc_capable(F.col("floor"), F.col("verified"), F.col("upstream"))
    return rows.select(*T.finding(
        scanner_id=F.lit(scanner), view=F.lit(view), asset_type=F.lit("library"), primitive=F.lit("unknown"), algorithm=F.col("library"),
        params=T.text_map(version=F.col("upstream"), package=F.col("package"), package_version=F.col("version"),
                          source_package=F.col("source"), pqc_capable=capable, eol=F.col("eol")),
        locator=F.col("path"), detail=detail, snippet=F.concat_ws(" ", "package", "version")))


# --- installed package databases --------------------------------------------

def _stanzas(databases: DataFrame) -> DataFrame:
    keep = [c for c in databases.columns if c != "text"]
    return databases.select(*keep, F.posexplode(F.split("text", r"(?:\r?\n)[^\S\n]*(?=\r?\n)")).alias("stanza_no", "stanza"))


def _field(name: str, text: str = "stanza") -> Column:
    """The last line starting with ``name:``; continuation lines do not count."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?m)^({name}[^\S\n]*:[^\n]*)$"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    return F.when(last.isNotNull(), F.btrim(F.regexp_replace(last, r"^[^:]*:", ""), F.lit(" \t\r")))


def dpkg_packages(databases: DataFrame) -> DataFrame:
    """Installed packages of dpkg status text (scan_id, system, path, text)."""
    rows = _stanzas(databases).select(
        "scan_id", "system", "path", F.lit("distro").alias("ecosystem"), _field("(?i:package)").alias("package"),
        F.coalesce(_field("(?i:version)"), F.lit("")).alias("version"), _field("(?i:source)").alias("source"),
        F.coalesce(_field("(?i:status)"), F.lit("")).alias("status"))
    return rows.filter(F.contains("status", F.lit(" installed")) & F.col("package").isNotNull()).drop("status")


def apk_packages(databases: DataFrame) -> DataFrame:
    rows = _stanzas(databases).select(
        "scan_id", "system", "path", F.lit("distro").alias("ecosystem"), _field("P").alias("package"), _field("V").alias("version"), _field("o").alias("source"))
    return rows.filter(F.col("package").isNotNull() & F.col("version").isNotNull())


# --- manifests and lockfiles ------------------------------------------------

def preferred_manifests(files: DataFrame) -> DataFrame:
    """The most certain file of each directory and ecosystem.

    Decided on names alone; the text of the others is never parsed. Vendored
    directories are skipped.
    """
    name = F.substring_index("path", "/", -1)
    rank, ecosystem = None, None
    for eco, ordered in MANIFESTS.items():
        for position, manifest in enumerate(ordered):
            rank = (F if rank is None else rank).when(name == manifest, F.lit(position))
            ecosystem = (F if ecosystem is None else ecosystem).when(name == manifest, F.lit(eco))
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    known = files.withColumn("manifest", name).withColumn("ecosystem", ecosystem).withColumn("rank", rank).withColumn("directory", directory)
    known = known.filter(F.col("rank").isNotNull() & T.outside(F.col("path"), T.DEPENDENCY_FOLDERS))
    key = ["scan_id", "system", "directory", "ecosystem"]
    best = known.groupBy(*key).agg(F.min("rank").alias("rank"))
    return known.join(best, [*key, "rank"]).drop("rank", "directory")


def _pair(package: Column, spec: Column) -> Column:
    return F.struct(package.alias("package"), F.trim(spec).alias("spec"))


def _matched(pattern: str) -> Column:
    """Pairs from groups 1 and 2 of every match in the text."""
    whole = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
    return F.transform(whole, lambda m: _pair(F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)))


def _json_fields(fields: tuple[str, ...], nested: bool) -> Column:
    """Pairs from maps of a JSON manifest; a file that is not JSON has none."""
    value = "struct<version:string>" if nested else "string"
    parsed = F.from_json("text", "struct<" + ",".join(f"`{f}`:map<string,{value}>" for f in fields) + ">")
    entries = F.flatten(F.array_compact(F.array(*[F.map_entries(parsed[f]) for f in fields])))
    return F.transform(entries, lambda e: _pair(
        F.regexp_replace(e["key"], r"^.*node_modules/", ""), F.coalesce(e["value"]["version"] if nested else e["value"], F.lit(""))))


_NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"
PARSERS = {
    "poetry.lock": lambda: _matched(r'(?s)\[\[package\]\]\s*name = "([^"]+)"\s*version = "([^"]+)"'),
    "Pipfile.lock": lambda: _json_fields(("default", "develop"), True),
    "requirements.txt": lambda: _matched(rf"(?m)^[^\S\n]*({_NAME})(?:\[[^\]\n]*\])?[^\S\n]*([<>=!~][^#;\n]*)?(?:[#;].*)?$"),
    "pyproject.toml": lambda: _matched(rf'"({_NAME})(?:\[[^\]]*\])?\s*([<>=!~][^";]*)(?:;[^"]*)?"'),
    "package-lock.json": lambda: _json_fields(("packages", "dependencies"), True),
    "yarn.lock": lambda: _matched(r'(?m)^"?(@?[^@"\s]+)@[^\n]*:\s*\n\s+version:? "?([^"\n]+)"?'),
    "package.json": lambda: _json_fields(("dependencies", "devDependencies"), False),
    "go.mod": lambda: _matched(r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+(v[0-9][^\s]*)"),
    "go.sum": lambda: _matched(r"(?m)^([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+(v[0-9][^\s/]*)\s"),
}
#: Files that hold exact versions by definition.
EXACT_FILES = ("poetry.lock", "package-lock.json", "yarn.lock", "go.mod", "go.sum")


def dependencies(files: DataFrame) -> DataFrame:
    """Every declared dependency with its version text and whether it is a range."""
    pairs = F
    for manifest, parse in PARSERS.items():
        pairs = pairs.when(F.col("manifest") == manifest, parse())
    rows = preferred_manifests(files).select("scan_id", "system", "path", "ecosystem", "manifest", F.explode(F.array_distinct(pairs)).alias("d"))
    spec = F.col("d.spec")
    bare = spec.rlike(r"^v?[0-9][0-9A-Za-z.!+-]*$") & (F.col("manifest") == "package.json")
    pinned = F.col("manifest").isin(*EXACT_FILES) | bare | spec.rlike(r"^={1,3}\s*v?[0-9][0-9A-Za-z.!+-]*$")
    return rows.filter("d.package <> ''").select(
        "scan_id", "system", "path", "ecosystem", "d.package",
        F.when(pinned, F.regexp_replace(spec, r"^=+\s*", "")).otherwise(spec).alias("version"), (~pinned).alias("version_is_range"))


def dependency_findings(files: DataFrame, facts: DataFrame) -> DataFrame:
    rows = join_libraries(dependencies(files), facts)
    ranged = F.col("version_is_range")
    capable = F.when(~ranged, is_pqc_capable(F.col("floor"), F.col("verified"), F.col("version")))
    return rows.select(*T.finding(
        scanner_id=F.lit("deps"), view=F.lit("declared"), asset_type=F.lit("library"), primitive=F.lit("unknown"), algorithm=F.col("library"),
        params=T.text_map(
            ecosystem=F.col("ecosystem"), package=F.col("package"), version=F.col("version"), pqc_capable=capable, eol=F.col("eol"),
            version_is_range=F.when(ranged, F.lit("true")), version_note=F.when(ranged, F.lit(RANGE_NOTE))),
        confidence=F.when(ranged, F.lit(RANGE_CONFIDENCE)).otherwise(F.lit(1.0)),
        locator=F.col("path"), detail=F.concat(F.lit("manifest="), F.substring_index("path", "/", -1)), snippet=F.concat_ws(" ", "package", "version")))


def lower_bound(specifier: Column) -> Column:
    """The lowest version a range admits, NULL when it names none."""
    bounded = F.regexp_extract(specifier, r"(?:>=|>|==|~=)\s*([0-9][0-9A-Za-z.*+!-]*)", 1)
    bare = F.trim(F.regexp_replace(specifier, r"^[\^~v= ]+", ""))
    return F.when(bounded != "", bounded).otherwise(F.when(bare.rlike(r"^[0-9]"), F.trim(F.substring_index(bare, ",", 1))))
