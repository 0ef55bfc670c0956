"""Row types and closed vocabularies shared by every transform."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed vocabularies of the inventory model.
VIEWS = ("declared", "shipped", "observed")
ASSET_TYPES = ("algorithm", "certificate", "protocol", "key", "library", "module", "service")
PRIMITIVES = (
    "pke", "signature", "kem", "key-agreement", "block-cipher", "stream-cipher",
    "hash", "mac", "kdf", "drbg", "unknown",
)
USAGES = (
    "sign", "verify", "key-exchange", "key-transport", "encrypt", "decrypt",
    "hash", "kdf", "unknown",
)
SECTORS = (
    "government", "strategic", "defence", "power", "telecom", "transport", "bfsi", "other",
)
EXPOSURES = ("internet", "internal", "build", "unknown")
TARGET_KINDS = ("repo", "directory", "image", "binary", "config", "host")
GAP_KINDS = ("unparsed", "partially-parsed")
SCAN_KINDS = ("scan", "fix", "rescore")
BANDS = ("Critical", "High", "Medium", "Low")

OCCURRENCE = T.StructType([
    T.StructField("view", T.StringType()),
    T.StructField("locator", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("snippet", T.StringType()),
])

#: One claim by one detector. ``params`` is the only open part of the row.
FINDING = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("system", T.StringType()),
    T.StructField("scanner_id", T.StringType()),
    T.StructField("view", T.StringType()),
    T.StructField("asset_type", T.StringType()),
    T.StructField("primitive", T.StringType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("usage", T.StringType()),
    T.StructField("configurable", T.BooleanType()),
    T.StructField("occurrences", T.ArrayType(OCCURRENCE)),
    T.StructField("confidence", T.DoubleType()),
])

FINDING_COLUMNS = tuple(field.name for field in FINDING.fields)

#: One handshake event line of the runtime spool.
