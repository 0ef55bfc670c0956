"""Evidence in raw bytes: identifiers, tables, banners, PEM blocks, symbols.

Bytes are read as ISO-8859-1 text, one character per byte, so offsets are byte
offsets and every search runs in the JVM. Signatures come from the knowledge
files (tens of them) and are compiled into the projection: no join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherfolio.functions import redact as R
from cipherfolio.knowledge import HERE, read_table
from cipherfolio.sources import files as T
from cipherfolio.sources.packages import is_pqc_capable

# Confidence of each technique.
CONFIDENCE = {"symbol": 0.90, "pem": 0.95, "oid": 0.85, "version-string": 0.80, "constant": 0.60}
# Library banners.
BANNERS = (
    ("OpenSSL", r"OpenSSL\s+(\d+\.\d+\.\d+[a-z]?)"),
    ("GnuTLS", r"GnuTLS\s+(\d+\.\d+\.\d+)"),
    ("libgcrypt", r"libgcrypt\s+(\d+\.\d+\.\d+)"),
    ("Mbed TLS", r"[Mm]bed\s?TLS\s+(\d+\.\d+\.\d+)"),
    ("wolfSSL", r"wolfSSL\s+(\d+\.\d+\.\d+)"),
    ("NSS", r"NSS\s+(\d+\.\d+(?:\.\d+)?)"),
)
PEM_BLOCK = r"(?s)-----BEGIN ([A-Z0-9 ]+)-----(.*?)-----END \1-----"


@dataclass(frozen=True)
class Signature:
    technique: str
    name: str
    pattern: bytes
    algorithm: str
    primitive: str = "unknown"
    usage: str = "unknown"
    params: dict[str, object] = field(default_factory=dict)


def encode_oid(dotted: str) -> bytes:
    """The DER bytes of an object identifier, tag and length included."""
    arcs = [int(part) for part in dotted.split(".")]
    content = bytearray()
    for arc in [arcs[0] * 40 + arcs[1], *arcs[2:]]:
        groups = [arc & 0x7F]
        while arc := arc >> 7:
            groups.append(arc & 0x7F | 0x80)
        content.extend(reversed(groups))
    return bytes([0x06, len(content)]) + bytes(content)


def default_signatures() -> list[Signature]:
    oids = [
        Signature("oid", e["oid"], encode_oid(e["oid"]), e["algorithm"], e["primitive"], e["usage"], e.get("params", {}))
        for e in read_table(HERE / "oids.toml")["oids"]
    ]
    tables = [
        Signature("constant", e["name"], bytes.fromhex(e["bytes"]), e["algorithm"], e["primitive"], e["usage"])
        for e in read_table(HERE / "constants.toml")["constants"]
    ]
    return oids + tables


def latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def signature_hits(blobs: DataFrame, signatures: Sequence[Signature] | None = None) -> DataFrame:
    """First offset of every signature in every blob (columns kept, content dropped)."""
    signatures = default_signatures() if signatures is None else signatures
    keep = [c for c in blobs.columns if c != "content"]
    text = F.col("_text")

    def hit(s: Signature) -> Column:
        at = F.locate(s.pattern.decode("latin-1"), text)
        params = {str(k): str(v) for k, v in s.params.items()}
        pairs = [F.lit(x) for pair in params.items() for x in pair]
        return F.when(at > 0, F.struct(
            F.lit(s.technique).alias("technique"), F.lit(s.name).alias("name"), (at - 1).cast("bigint").alias("offset"),
            F.lit(s.algorithm).alias("algorithm"), F.lit(s.primitive).alias("primitive"), F.lit(s.usage).alias("usage"),
            F.create_map(*pairs).cast("map<string,string>").alias("params")))

    rows = blobs.select(*keep, latin(F.col("content")).alias("_text"))
    return rows.select(*keep, F.explode(F.array_compact(F.array(*[hit(s) for s in signatures]))).alias("h")).select(*keep, "h.*")


def banner_hits(blobs: DataFrame, banners: Sequence[tuple[str, str]] = BANNERS) -> DataFrame:
    """The first banner of each library in each blob."""
    keep = [c for c in blobs.columns if c != "content"]
    text = F.col("_text")

    def hit(library: str, pattern: str) -> Column:
        return F.when(text.rlike(pattern), F.struct(
            F.lit(library).alias("library"), F.regexp_extract(text, pattern, 1).alias("version"),
            F.regexp_extract(text, pattern, 0).alias("banner"),
            (F.instr(text, F.regexp_extract(text, pattern, 0)) - 1).cast("bigint").alias("offset")))

    rows = blobs.select(*keep, latin(F.col("content")).alias("_text"))
    return rows.select(*keep, F.explode(F.array_compact(F.array(*[hit(*b) for b in banners]))).alias("h")).select(*keep, "h.*")


def pem_hits(texts: DataFrame, text: str = "text") -> DataFrame:
    """Every PEM block by label, digest and whether it is a private key; no bytes."""
    keep = [c for c in texts.columns if c != text]
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"({PEM_BLOCK.replace(chr(92) + '1', chr(92) + '2')})"), F.lit(1))
    found = texts.filter(F.contains(text, F.lit("-----BEGIN "))).select(*keep, F.posexplode(F.array_distinct(blocks)).alias("n", "block"), F.col(text).alias("_text"))
    label = F.regexp_extract("block", r"-----BEGIN ([A-Z0-9 ]+)-----", 1)
    return found.select(
        *keep, label.alias("label"), F.substring(F.sha2(F.col("block"), 256), 1, 32).alias("fingerprint"),
        (F.instr("_text", F.col("block")) - 1).cast("bigint").alias("offset"), F.contains(label, F.lit("PRIVATE KEY")).alias("is_private"))


def signature_findings(blobs: DataFrame, signatures: Sequence[Signature] | None = None) -> DataFrame:
    rows = signature_hits(blobs, signatures)
    known = CONFIDENCE
    confidence = F.when(F.col("technique") == "oid", F.lit(known["oid"])).otherwise(F.lit(known["constant"]))
    return rows.select(*T.finding(
        scanner_id=F.lit("binary"), view=F.lit("shipped"), asset_type=F.lit("algorithm"), primitive=F.col("primitive"), algorithm=F.col("algorithm"),
        params=F.col("params"), usage=F.col("usage"), confidence=confidence,
        locator=F.concat(F.col("path"), F.lit("#offset+"), F.col("offset").cast("string")),
        detail=F.concat_ws("=", "technique", "name"), snippet=F.concat_ws(" ", F.lit("at offset"), F.col("offset").cast("string"))))


def banner_findings(blobs: DataFrame, facts: DataFrame, banners: Sequence[tuple[str, str]] = BANNERS) -> DataFrame:
    """Banners with the capability their library's confirmed floor gives them."""
    by_name = facts.filter("ecosystem = 'distro'").select(F.col("package_key").alias("_key"), "floor", "verified").distinct()
    rows = banner_hits(blobs, banners).withColumn("_key", F.lower("library")).join(by_name, "_key", "left")
    return rows.select(*T.finding(
        scanner_id=F.lit("binary"), view=F.lit("shipped"), asset_type=F.lit("library"), primitive=F.lit("unknown"), algorithm=F.col("library"),
        params=T.text_map(version=F.col("version"), library=F.col("library"), pqc_capable=is_pqc_capable(F.col("floor"), F.col("verified"), F.col("version"))),
        confidence=F.lit(CONFIDENCE["version-string"]), locator=F.concat(F.col("path"), F.lit("#offset+"), F.col("offset").cast("string")),
        detail=F.concat(F.lit("version-banner="), F.concat_ws(" ", "library", "version")), snippet=F.col("banner")))


def pem_findings(texts: DataFrame) -> DataFrame:
    rows = pem_hits(texts)
    private = F.col("is_private")
    return rows.select(*T.finding(
        scanner_id=F.lit("binary"), view=F.lit("shipped"), asset_type=F.when(private, F.lit("key")).otherwise(F.lit("certificate")),
        primitive=F.lit("unknown"), algorithm=F.lit("unknown"),
        params=T.text_map(pem_label=F.col("label"), fingerprint=F.when(private, F.col("fingerprint"))),
        confidence=F.lit(CONFIDENCE["pem"]), locator=F.concat(F.col("path"), F.lit("#offset+"), F.col("offset").cast("string")),
        detail=F.concat(F.lit("pem="), "label"), snippet=F.when(private, F.lit(R.REDACTED)).otherwise(F.col("label"))))


def symbols(spark: SparkSession, entries: list[dict] | None = None) -> DataFrame:
    entries = read_table(HERE / "symbols.toml")["symbols"] if entries is None else entries
    rows = [
        (e["symbol"], e["library"], e["algorithm"], e["primitive"], e["usage"], {k: str(v) for k, v in e.get("params", {}).items()})
        for e in entries
    ]
    return spark.createDataFrame(rows, "symbol string, library string, algorithm string, primitive string, usage string, params map<string,string>")


def symbol_hits(imports: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Known imported symbols, once per binary (scan_id, system, path, symbol)."""
    bare = imports.withColumn("symbol", F.regexp_replace("symbol", r"@+.*$", ""))
    # The dictionary is a small table of the knowledge files. It is sent to the imports, so these are neither shuffled nor sorted
    # by symbol, whose common ones would meet in one task; of what it knows, tasks hold each symbol of a binary once.
    once = bare.join(F.broadcast(dictionary.select("symbol")), "symbol", "left_semi").dropDuplicates(["scan_id", "system", "path", "symbol"])
    return once.join(F.broadcast(dictionary.dropDuplicates(["symbol"])), "symbol")


def symbol_findings(imports: DataFrame, dictionary: DataFrame) -> DataFrame:
    rows = symbol_hits(imports, dictionary)
    return rows.select(*T.finding(
        scanner_id=F.lit("binary"), view=F.lit("shipped"), asset_type=F.lit("algorithm"), primitive=F.col("primitive"), algorithm=F.col("algorithm"),
        params=F.coalesce("params", F.create_map().cast("map<string,string>")), usage=F.col("usage"), confidence=F.lit(CONFIDENCE["symbol"]),
        locator=F.concat_ws("#", "path", "symbol"), detail=F.concat(F.lit("symbol="), "symbol"), snippet=F.concat(F.lit("imported symbol "), "symbol")))
