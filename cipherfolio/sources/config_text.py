"""TLS and SSH policy out of configuration text, as jobs over a lines table.

Input files carry scan_id, system, path, text. Lines that can neither change
the block structure nor hold a wanted directive are dropped before the only
shuffle, which is by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherfolio.functions import canonical as C
from cipherfolio.sources import files as T

FILE = ["scan_id", "system", "path"]

# Directives, keywords and keys worth reading.
NGINX_TLS = ("ssl_protocols", "ssl_ciphers", "ssl_ecdh_curve", "ssl_certificate", "ssl_certificate_key", "ssl_conf_command")
NGINX_PLACE = ("listen", "server_name")
SSHD_KEYWORDS = {
    "kexalgorithms": ("SSH-KEX", "key-agreement"),
    "ciphers": ("SSH-CIPHERS", "block-cipher"),
    "macs": ("SSH-MACS", "mac"),
    "hostkeyalgorithms": ("SSH-HOSTKEY", "signature"),
}
OPENSSL_SECTION = "system_default_sect"
OPENSSL_KEYS = ("groups", "cipherstring", "ciphersuites", "minprotocol", "maxprotocol")

_OPEN = r"^\s*(\w+)([^{;]*)\{\s*$"
_DIRECTIVE = r"^\s*(\w+)\s+([^;]+);"


def nginx_lines(files: DataFrame) -> DataFrame:
    """The structural and wanted lines of nginx text with their block."""
    code = T.lines(files).withColumn("code", T.without_remark(F.col("line")))
    opens = F.col("code").rlike(_OPEN)
    closes = ~opens & F.col("code").rlike(r"^\s*\}")
    name = F.regexp_extract("code", _DIRECTIVE, 1)
    wanted = ~opens & ~closes & name.isin(*NGINX_TLS, *NGINX_PLACE)
    marked = code.select(
        *FILE, "line_no",
        F.when(opens, 1).when(closes, -1).otherwise(0).alias("step"),
        F.when(opens, F.regexp_extract("code", _OPEN, 1)).alias("block"),
        F.when(wanted, name).alias("name"),
        F.when(wanted, F.trim(F.regexp_extract("code", _DIRECTIVE, 2))).alias("value"),
    ).filter("step <> 0 OR name IS NOT NULL")

    order = Window.partitionBy(*FILE).orderBy("line_no")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    # A close at depth 0 closes nothing: depth is the sum reflected at zero.
    total = F.sum("step").over(sofar)
    depth = marked.withColumn("total", total).withColumn(
        "depth", F.col("total") - F.least(F.lit(0), F.min("total").over(sofar)))
    before = F.coalesce(F.lag("depth").over(order), F.lit(0))
    leveled = depth.withColumn("level", F.when(F.col("step") < 0, before).otherwise(F.col("depth")))
    level = Window.partitionBy(*FILE, "level").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    topped = leveled.withColumn("top", F.when(F.col("level") > 0, F.last("block", ignorenulls=True).over(level)))
    opened = F.last(F.when(F.col("block") == "server", F.col("line_no")), ignorenulls=True).over(sofar)
    closed = F.last(F.when((F.col("step") < 0) & (F.col("top") == "server"), F.col("line_no")), ignorenulls=True).over(sofar)
    return topped.withColumn("server_line", opened).withColumn("closed_line", closed)


def nginx_blocks(files: DataFrame) -> DataFrame:
    """One row per TLS-terminating server block: endpoint and last directives."""
    inside = nginx_lines(files).filter(
        F.col("name").isNotNull() & (F.col("top") == "server") & F.col("server_line").isNotNull()
        & (F.col("server_line") > F.coalesce("closed_line", F.lit(0))))
    first = F.get(F.split("value", r"\s+"), F.lit(0))
    tail = F.substring_index(first, ":", -1)
    port = F.when(tail != "", tail).otherwise(first)
    is_listen, is_name = F.col("name") == "listen", F.col("name") == "server_name"

    def last(directive: str) -> Column:
        return F.max(F.when(F.col("name") == directive, F.struct("line_no", "value"))).alias(directive)

    blocks = inside.groupBy(*FILE, "server_line").agg(
        F.min(F.when(is_listen & (port != ""), F.struct(F.col("line_no"), port.alias("value")))).alias("port"),
        F.min(F.when(is_name, F.struct(F.col("line_no"), first.alias("value")))).alias("host"),
        F.bool_or(is_listen & F.array_contains(F.split("value", r"\s+"), "ssl")).alias("listens_ssl"),
        *[last(d) for d in NGINX_TLS],
    )
    has_directive = F.greatest(*[F.col(d).isNotNull() for d in NGINX_TLS])
    endpoint = F.concat(F.coalesce("host.value", F.lit("")), F.lit(":"), F.coalesce("port.value", F.lit("")))
    return blocks.filter(has_directive | F.col("listens_ssl")).withColumn("endpoint", endpoint).drop("host", "port", "listens_ssl")


def _parts(value: Column, pattern: str) -> Column:
    return F.filter(F.split(value, pattern), lambda p: F.trim(p) != "")


def _group_params(endpoint: Column, value: Column) -> tuple[Column, Column]:
    """``(first group, params)`` of a colon-separated group list."""
    listed = _parts(value, ":")
    first = C.canonical_group(F.coalesce(F.get(listed, F.lit(0)), value))
    hybrid = F.upper(first).rlike("|".join(C.PQ_MARKERS))
    return first, T.text_map(
        endpoint=endpoint, group=first, hybrid=hybrid, groups=F.array_join(F.transform(listed, lambda p: C.canonical_group(p)), ","))


def _suites(value: Column) -> Column:
    return F.array_join(F.filter(F.split(value, ":"), lambda p: p != ""), ",")


def _emit(rows: DataFrame, candidates: list[Column]) -> DataFrame:
    """Explode the struct candidates of a row and shape them as findings."""
    found = rows.select(*FILE, F.explode(F.array_compact(F.array(*candidates))).alias("f"))
    return found.select(*T.finding(
        scanner_id=F.lit("config"), view=F.lit("declared"), asset_type=F.col("f.asset_type"), primitive=F.col("f.primitive"),
        algorithm=F.col("f.algorithm"), params=F.col("f.params"), configurable=F.lit(True),
        locator=F.concat_ws(":", "path", F.col("f.line").cast("string")), detail=F.col("f.detail"), snippet=F.col("f.snippet")))


def _claim(asset_type: str, primitive: str, algorithm: Column, params: Column, line: Column, detail: str, snippet: Column) -> Column:
    return F.struct(
        F.lit(asset_type).alias("asset_type"), F.lit(primitive).alias("primitive"), algorithm.alias("algorithm"),
        params.alias("params"), line.cast("bigint").alias("line"), F.lit(detail).alias("detail"), snippet.alias("snippet"))


def nginx_findings(files: DataFrame) -> DataFrame:
    rows = nginx_blocks(files)
    endpoint = F.col("endpoint")
    protocols, ciphers = F.col("ssl_protocols"), F.col("ssl_ciphers")
    versions = _parts(protocols["value"], r"\s+")
    group, group_params = _group_params(endpoint, F.col("ssl_ecdh_curve.value"))
    protocol = _claim(
        "protocol", "unknown", F.lit("TLS"),
        T.text_map(endpoint=endpoint, versions=F.array_join(versions, ","), min_version=C.lowest_tls_version(versions),
                   cipher_suites=_suites(ciphers["value"])),
        F.coalesce(protocols["line_no"], ciphers["line_no"]), "nginx ssl_protocols/ssl_ciphers", F.coalesce(protocols["value"], ciphers["value"]))
    exchange = _claim("algorithm", "key-agreement", group, group_params, F.col("ssl_ecdh_curve.line_no"), "nginx ssl_ecdh_curve", F.col("ssl_ecdh_curve.value"))
    certificate = _claim(
        "certificate", "unknown", F.lit("unknown"),
        T.text_map(endpoint=endpoint, path=F.col("ssl_certificate.value"), resolved=F.lit("false")),
        F.col("ssl_certificate.line_no"), "nginx ssl_certificate", F.col("ssl_certificate.value"))
    return _emit(rows, [
        F.when(protocols.isNotNull() | ciphers.isNotNull(), protocol),
        F.when(F.col("ssl_ecdh_curve").isNotNull(), exchange),
        F.when(F.col("ssl_certificate").isNotNull(), certificate),
    ])


def sshd_settings(files: DataFrame) -> DataFrame:
    """The first occurrence of each keyword: what the daemon uses."""
    shape = r"^\s*([A-Za-z][A-Za-z0-9]*)\s+(.+?)\s*$"
    code = T.lines(files).withColumn("code", T.without_remark(F.col("line")))
    keyed = code.select(
        *FILE, "line_no", F.lower(F.regexp_extract("code", shape, 1)).alias("keyword"),
        F.trim(F.regexp_extract("code", shape, 2)).alias("value"),
    ).filter(F.col("keyword").isin(*SSHD_KEYWORDS))
    return keyed.groupBy(*FILE, "keyword").agg(F.min(F.struct("line_no", "value")).alias("first")).select(
        *FILE, "keyword", "first.line_no", "first.value")


def sshd_findings(files: DataFrame) -> DataFrame:
    rows = sshd_settings(files)
    algorithm = C.lookup({k: v[0] for k, v in SSHD_KEYWORDS.items()}, F.col("keyword"))
    primitive = C.lookup({k: v[1] for k, v in SSHD_KEYWORDS.items()}, F.col("keyword"))
    endpoint = F.concat(F.lit("sshd@"), F.coalesce("system", F.lit("system")))
    return rows.select(*T.finding(
        scanner_id=F.lit("config"), view=F.lit("declared"), asset_type=F.lit("algorithm"), primitive=primitive, algorithm=algorithm,
        params=T.text_map(endpoint=endpoint, algorithms=F.col("value")), configurable=F.lit(True),
        locator=F.concat_ws(":", "path", F.col("line_no").cast("string")), detail=F.lit("sshd_config"), snippet=F.col("value")))


def openssl_settings(files: DataFrame) -> DataFrame:
    """The last value of each key in the system default section, one row per file."""
    header, assign = r"^\s*\[\s*([^\]]+?)\s*\]", r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.+?)\s*$"
    code = T.lines(files).withColumn("code", T.without_remark(F.col("line")))
    is_header = F.col("code").rlike(header)
    marked = code.select(
        *FILE, "line_no",
        F.when(is_header, F.lower(F.trim(F.regexp_extract("code", header, 1)))).alias("section"),
        F.when(~is_header, F.lower(F.regexp_extract("code", assign, 1))).alias("key"),
        F.trim(F.regexp_extract("code", assign, 2)).alias("value"),
    ).filter(F.col("section").isNotNull() | F.col("key").isin(*OPENSSL_KEYS))
    sofar = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("section", F.last("section", ignorenulls=True).over(sofar)).filter(
        (F.col("section") == OPENSSL_SECTION) & F.col("key").isNotNull())
    return placed.groupBy(*FILE).agg(*[
        F.max(F.when(F.col("key") == k, F.struct("line_no", "value"))).alias(k) for k in OPENSSL_KEYS])


def openssl_findings(files: DataFrame) -> DataFrame:
    rows = openssl_settings(files)
    endpoint = F.concat(F.lit("openssl@"), F.coalesce("system", F.lit("system")))
    groups, low, high = F.col("groups"), F.col("minprotocol"), F.col("maxprotocol")
    suites = F.coalesce("cipherstring", "ciphersuites")
    group, group_params = _group_params(endpoint, groups["value"])
    return _emit(rows, [
        F.when(groups.isNotNull(), _claim("algorithm", "key-agreement", group, group_params, groups["line_no"], "openssl.cnf Groups", groups["value"])),
        F.when(low.isNotNull() | high.isNotNull() | suites.isNotNull(), _claim(
            "protocol", "unknown", F.lit("TLS"),
            T.text_map(endpoint=endpoint, min_version=low["value"], max_version=high["value"], cipher_suites=_suites(suites["value"])),
            F.coalesce(low["line_no"], high["line_no"], suites["line_no"]), "openssl.cnf system_default_sect",
            F.coalesce(low["value"], high["value"], suites["value"]))),
    ])


def config_findings(files: DataFrame) -> DataFrame:
    """Every configuration file by the format its name says; other files give no row."""
    kind = T.config_kind(F.col("path"))
    return (
        nginx_findings(files.filter(kind == "nginx"))
        .unionByName(sshd_findings(files.filter(kind == "sshd")))
        .unionByName(openssl_findings(files.filter(kind == "openssl")))
    )
