"""Reading files as rows and cutting their text into lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders never read, and executable magic numbers.
SKIPPED_FOLDERS = (".git", ".venv", "node_modules", "vendor", "__pycache__")
DEPENDENCY_FOLDERS = ("node_modules", "vendor", "site-packages", ".venv", "dist", "build")
#: The reader holds a file in one cell; a larger one is reported as a coverage gap, never dropped silently.
READER_LIMIT = 2**31 - 1024
EXECUTABLE_MAGIC = ("7F454C46", "4D5A", "CFFAEDFE", "CEFAEDFE", "CAFEBABE")
# Names of configuration files, and the folders whose ``.conf`` files belong to nginx.
SSHD_NAMES = ("sshd_config",)
OPENSSL_NAMES = ("openssl.cnf", "openssl.conf")
NGINX_NAMES = ("nginx.conf",)
NGINX_FOLDERS = ("conf.d", "sites-available", "sites-enabled", "snippets")


def outside(path: Column, folders: Sequence[str] = SKIPPED_FOLDERS) -> Column:
    """Whether no path segment is one of ``folders``."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(f) for f in folders]))


def listed(spark: SparkSession, root: str, folders: Sequence[str] = SKIPPED_FOLDERS) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.filter(outside(F.col("path"), folders))


def read_files(spark: SparkSession, root: str, max_bytes: int | None = None, folders: Sequence[str] = SKIPPED_FOLDERS) -> DataFrame:
    """Files under ``root`` as (path, length, content), all of them unless ``max_bytes`` is given.

    Path and size are tested on the listing; only ``content`` of the files
    that pass is read. ``file_gaps`` has the rest.
    """
    limit = READER_LIMIT if max_bytes is None else min(max_bytes, READER_LIMIT)
    return listed(spark, root, folders).filter(F.col("length") <= limit).select("path", "length", "content")


def file_gaps(spark: SparkSession, root: str, max_bytes: int | None = None, folders: Sequence[str] = SKIPPED_FOLDERS) -> DataFrame:
    """(path, length, kind, reason) of the files that ``read_files`` with the same limits leaves out. Reads no content."""
    limit = READER_LIMIT if max_bytes is None else min(max_bytes, READER_LIMIT)
    larger = listed(spark, root, folders).filter(F.col("length") > limit)
    return larger.select("path", "length", F.lit("unparsed").alias("kind"), F.concat(F.lit("larger than "), F.lit(limit), F.lit(" bytes")).alias("reason"))


def text_gaps(files: DataFrame) -> DataFrame:
    """(scan_id, scanner, path, kind, reason) of text files (scan_id, path, text) that their reader cannot take whole:
    bytes that were no UTF-8, and documents named as JSON that are none."""
    damaged = F.contains(F.col("text"), F.lit("\ufffd"))
    broken = F.col("path").endswith(".json") & F.try_parse_json("text").isNull()
    gap = F.when(broken, F.struct(F.lit("unparsed").alias("kind"), F.lit("not valid JSON").alias("reason"))).when(
        damaged, F.struct(F.lit("partially-parsed").alias("kind"), F.lit("not valid UTF-8").alias("reason")))
    scanner = F.when(config_kind(F.col("path")).isNotNull(), F.lit("config")).when(F.col("path").endswith(".json"), F.lit("deps")).otherwise(F.lit("source"))
    return files.select("scan_id", scanner.alias("scanner"), "path", gap.alias("gap")).filter("gap IS NOT NULL").select("scan_id", "scanner", "path", "gap.kind", "gap.reason")


def config_kind(path: Column) -> Column:
    """The format a file's name says: sshd, openssl, nginx, or NULL for every other file."""
    name = F.substring_index(path, "/", -1)
    folders = F.array(*[F.lit(f) for f in NGINX_FOLDERS])
    nginx = name.isin(*NGINX_NAMES) | (name.endswith(".conf") & F.arrays_overlap(F.split(path, "/"), folders))
    return F.when(name.isin(*SSHD_NAMES), F.lit("sshd")).when(name.isin(*OPENSSL_NAMES), F.lit("openssl")).when(nginx, F.lit("nginx"))


def config_files(spark: SparkSession, root: str) -> DataFrame:
    rows = read_files(spark, root).filter(config_kind(F.col("path")).isNotNull())
    return rows.select("path", F.decode("content", "UTF-8").alias("text"))


def executables(spark: SparkSession, root: str) -> DataFrame:
    """Files that start like an ELF, PE or Mach-O image."""
    return read_files(spark, root).filter(has_magic(F.col("content")))


def has_magic(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    joined = F.lit(False)
    for magic in EXECUTABLE_MAGIC:
        joined = joined | head.startswith(magic)
    return joined


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1."""
    kept = [c for c in files.columns if c != text]
    return files.select(*kept, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("at", "line")).select(
        *kept, (F.col("at") + 1).alias("line_no"), "line")


def without_remark(line: Column) -> Column:
    return F.substring_index(line, "#", 1)


def finding(**columns: Column) -> list[Column]:
    """The FINDING columns with defaults for what is not given."""
    params = columns["params"]
    occurrence = F.struct(
        columns["view"].alias("view"), columns["locator"].alias("locator"),
        columns["detail"].alias("detail"), columns.get("snippet", F.lit(None).cast("string")).alias("snippet"),
    )
    return [
        F.col("scan_id"), F.col("system"), columns["scanner_id"].alias("scanner_id"), columns["view"].alias("view"),
        columns["asset_type"].alias("asset_type"), columns["primitive"].alias("primitive"), columns["algorithm"].alias("algorithm"),
        F.map_filter(params, lambda _, v: v.isNotNull()).alias("params"),
        columns.get("usage", F.lit("unknown")).alias("usage"),
        columns.get("configurable", F.lit(None).cast("boolean")).alias("configurable"),
        F.array(occurrence).alias("occurrences"), columns.get("confidence", F.lit(1.0)).cast("double").alias("confidence"),
    ]


def text_map(**pairs: Column) -> Column:
    return F.create_map(*[part for name, value in pairs.items() for part in (F.lit(name), value.cast("string"))])
