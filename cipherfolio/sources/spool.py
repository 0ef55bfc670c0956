"""Runtime handshake events: spool lines, trust checks, findings.

The same functions run on a batch and on a stream of lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cipherfolio.functions import canonical as C
from cipherfolio.sources import files as T

# The range of process ids, spool file names.
MAX_PID = 4_194_304
SUFFIXES = (".jsonl", ".json")
TEMPORARY = ".tmp-"
PROBE = "SSL_do_handshake"
FIELDS = ("observed_version", "observed_cipher", "observed_group")


def complete_file(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Published files only; a file still being written has a temporary name."""
    suffixed = F.lit(False)
    for suffix in suffixes:
        suffixed = suffixed | name.endswith(suffix)
    return suffixed & ~name.startswith(TEMPORARY) & ~name.startswith(".")


def _split_rows(rows: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """(path, block, line): every line with its file and where the split that holds it begins."""
    named = rows.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return named.filter(complete_file(F.col("file"), suffixes)).drop("file")


def number_lines(rows: DataFrame) -> DataFrame:
    """(path, line_no, line) of split rows, without blank lines.

    Rows of a split are consecutive in their task. How many lines the splits before it hold is counted, so no line is
    shuffled to be numbered, and a file is never one cell. Works on a batch and inside a micro-batch, which holds whole files.
    """
    placed = rows.withColumn("at", F.monotonically_increasing_id())
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).select(
        "path", "block", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0)) - 1).alias("offset"))
    numbered = placed.join(splits, ["path", "block"]).select("path", (F.col("at") - F.col("offset")).cast("int").alias("line_no"), "line")
    return numbered.filter(F.trim("line") != "")


def read_spool(spark: SparkSession, directory: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(path, line_no, line) of every published file; not recursive, no blank lines. Large files are read in splits."""
    return number_lines(_split_rows(spark.read.option("lineSep", "\n").text(directory), suffixes))


def stream_spool(spark: SparkSession, directory: str, archive: str | None = None, max_files: int = 1000, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """The spool as a stream of split rows: each file once and in splits, kept in ``archive`` afterwards.

    A stream cannot number rows across splits; ``number_lines`` does so in each micro-batch.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files).option("lineSep", "\n")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return _split_rows(reader.text(directory), suffixes)


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("event", f"$.{path}", kind)


def _kind(path: str) -> Column:
    """JSON type of a member, NULL when absent, ``VOID`` for null."""
    return F.schema_of_variant(F.try_variant_get("event", f"$.{path}", "variant"))


def _clean(path: str) -> Column:
    return F.trim(F.substring_index(_get(path, "string"), "\u0000", 1))


def judge_lines(lines: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Every line with its parsed event and why it was rejected, if it was.

    A longest line is only tested where ``max_bytes`` is given.
    """
    fits = F.lit(True) if max_bytes is None else F.octet_length("line") <= max_bytes
    # Generated, not projected: filters on the event then cannot be pushed
    # below the parser, where each test would parse the line again.
    parsed = lines.select("*", F.explode(F.array(F.when(fits, F.try_parse_json("line")))).alias("event"))
    is_object = F.schema_of_variant("event").startswith("OBJECT")
    pid = F.when(_kind("pid") == "BIGINT", _get("pid", "bigint"))
    comm = F.when(_kind("comm") == "STRING", _clean("comm"))
    negotiated = F.coalesce((_get("phase", "string") == "return") & (_get("retval", "bigint") == 1), F.lit(False))
    mistyped = F.lit(False)
    for field in FIELDS:
        mistyped = mistyped | (negotiated & F.coalesce(~_kind(field).isin("STRING", "VOID"), F.lit(False)))
    mappable = pid.between(1, MAX_PID) & comm.rlike(r"[\x20-\x7e]") & ~mistyped
    reason = (
        F.when(~fits, F.lit("line too long"))
        .when(F.col("event").isNull(), F.lit("not valid JSON"))
        .when(~is_object, F.lit("not an object"))
        .when(~F.coalesce(mappable, F.lit(False)), F.lit("event could not be mapped"))
    )
    return parsed.withColumn("reject_reason", reason)


def split_lines(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = judged.filter("reject_reason IS NULL").drop("reject_reason")
    bad = judged.filter("reject_reason IS NOT NULL").select("path", "line_no", "reject_reason", "line")
    return good, bad


def file_verdicts(judged: DataFrame) -> DataFrame:
    """A file with one valid line is consumed; one with none is rejected and kept."""
    counts = judged.groupBy("path").agg(
        F.count_if(F.col("reject_reason").isNull()).alias("valid"), F.count_if(F.col("reject_reason").isNotNull()).alias("skipped"))
    return counts.withColumn("verdict", F.when(F.col("valid") > 0, F.lit("consumed")).otherwise(F.lit("rejected")))


def line_gaps(judged: DataFrame) -> DataFrame:
    """(path, kind, reason): what of a file could not be taken; a file without any valid line is unparsed."""
    kind = F.when(F.col("verdict") == "consumed", F.lit("partially-parsed")).otherwise(F.lit("unparsed"))
    reasons = judged.filter("reject_reason IS NOT NULL").select("path", F.col("reject_reason").alias("reason")).distinct()
    return reasons.join(file_verdicts(judged), "path").select("path", kind.alias("kind"), "reason")


def parse_events(good: DataFrame) -> DataFrame:
    """Typed event columns of accepted lines, other columns kept."""
    keep = [c for c in good.columns if c not in ("event", "line")]
    return good.select(
        *keep, _get("pid", "bigint").alias("pid"), _get("tid", "bigint").alias("tid"), _clean("comm").alias("comm"),
        _clean("libssl_path").alias("libssl_path"), _clean("phase").alias("phase"),
        _get("retval", "bigint").alias("retval"), _get("timestamp", "bigint").alias("timestamp"),
        *[_get(f, "string").alias(f) for f in FIELDS], _clean("enrichment_reason").alias("enrichment_reason"))


def grade_events(events: DataFrame, longest: int | None = None) -> DataFrame:
    """Clean the negotiated values and say how much of them was read.

    Nothing is negotiated before a handshake returns successfully, and a value
    that cannot be a name is absent with a reason. A longest name is only
    tested where ``longest`` is given.
    """
    negotiated = F.coalesce((F.col("phase") == "return") & (F.col("retval") == 1), F.lit(False))
    rows = events.withColumn("negotiated", negotiated)

    def too_long(text: Column) -> Column:
        return F.lit(False) if longest is None else F.length(text) > longest

    reasons = [
        F.when(F.col("enrichment_reason") != "", F.col("enrichment_reason")),
        F.when(~F.col("negotiated"), F.when(F.coalesce(F.col("phase"), F.lit("unknown")) != "return", F.lit("the handshake had not completed")).otherwise(
            F.concat(F.lit("the handshake returned "), F.coalesce(F.col("retval").cast("string"), F.lit("nothing"))))),
    ]
    for field in FIELDS:
        raw = F.when(F.col("negotiated"), F.col(field))
        text = F.trim(F.substring_index(raw, "\u0000", 1))
        why = (
            F.when(text == "", F.lit(f"{field} was empty"))
            .when(too_long(text), F.lit(f"{field} was too long to be a name"))
            .when(~text.rlike(r"^[\x20-\x7e]+$"), F.lit(f"{field} was not printable"))
        )
        reasons.append(why)
        rows = rows.withColumn(field.replace("observed_", ""), F.when(why.isNull(), text))
    read = sum((F.col(n).isNotNull().cast("int") for n in ("version", "cipher", "group")), F.lit(0))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in ("version", "cipher", "group")])), ", ")
    grade = F.when(F.col("read") == 3, F.lit("full")).when(F.col("read") > 0, F.lit("partial")).otherwise(F.lit("none"))
    stated = F.array_distinct(F.array_compact(F.array(*reasons)))
    default = F.when(F.col("enrichment") == "partial", F.concat(missing, F.lit(" not read: the process did not ask for them"))).when(
        (F.col("enrichment") == "none") & F.col("negotiated"), F.lit("no accessor was called by the process"))
    return (
        rows.withColumn("stated", stated).withColumn("read", read).withColumn("enrichment", grade)
        .withColumn("reason", F.when(F.col("enrichment") != "full", F.when(F.size("stated") > 0, F.array_join("stated", "; ")).otherwise(default)))
        .drop("stated", "read", *FIELDS, "enrichment_reason")
    )


def event_findings(events: DataFrame, host: Column | None = None, longest: int | None = None) -> DataFrame:
    """One to three observed findings per event: protocol, suite, group.

    Needs scan_id and system columns.
    """
    rows = grade_events(events, longest)
    host = F.lit("localhost") if host is None else host
    version, suite, group = F.col("version"), F.col("cipher"), F.col("group")
    shared = dict(enrichment=F.col("enrichment"), enrichment_reason=F.col("reason"),
                  pending_enrichment=F.when(F.col("enrichment") == "none", F.lit("true")), version=version)

    def claim(kind: str, primitive: Column, algorithm: Column, usage: str, **extra: Column) -> Column:
        return F.struct(F.lit(kind).alias("asset_type"), primitive.alias("primitive"), algorithm.alias("algorithm"), F.lit(usage).alias("usage"),
                        T.text_map(**shared, **extra).alias("params"))

    hybrid = F.when(F.upper(group).rlike("|".join(C.PQ_MARKERS)), F.lit("true"))
    claims = F.array_compact(F.array(
        claim("protocol", F.lit("unknown"), F.lit("TLS"), "unknown"),
        F.when(suite.isNotNull(), claim("algorithm", C.suite_primitive(suite), suite, "encrypt", cipher_suite=suite)),
        F.when(group.isNotNull(), claim("algorithm", F.lit("key-agreement"), group, "key-exchange", group=group, hybrid=hybrid)),
    ))
    pending = F.lit("pending")
    detail = F.concat(F.lit(f"probe={PROBE} observed_version="), F.coalesce(version, pending), F.lit(" observed_cipher="), F.coalesce(suite, pending),
                      F.lit(" observed_group="), F.coalesce(group, pending))
    exploded = rows.select("scan_id", "system", "pid", host.alias("host"), detail.alias("detail"),
                           F.concat("comm", F.lit(" via "), F.when(F.col("libssl_path") != "", F.col("libssl_path")).otherwise(F.lit("unknown"))).alias("snippet"),
                           F.explode(claims).alias("c"))
    return exploded.select(*T.finding(
        scanner_id=F.lit("runtime-spool"), view=F.lit("observed"), asset_type=F.col("c.asset_type"), primitive=F.col("c.primitive"),
        algorithm=F.col("c.algorithm"), params=F.col("c.params"), usage=F.col("c.usage"),
        locator=F.concat(F.lit("host:"), "host", F.lit(":pid"), F.col("pid").cast("string")), detail=F.col("detail"), snippet=F.col("snippet")))
