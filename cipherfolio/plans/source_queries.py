"""Reading configuration, packages, manifests, code, bytes and free text."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from cipherfolio.functions import redact as R
from cipherfolio.operators.durable import durable
from cipherfolio.plans import testbed as B
from cipherfolio.plans.inventory_queries import joined, param
from cipherfolio.sources import bytescan, config_text, detect, files, packages

SECRET_WORDS = (*R.SECRET_WORDS, "token")


def _claims(rows, *names):
    """The identifying part of findings as flat columns."""
    o = F.get("occurrences", F.lit(0))
    return rows.select(
        "asset_type", "primitive", "algorithm", "usage", "configurable", F.round("confidence", 4).alias("confidence"),
        *[param(n).alias(n) for n in names], o["locator"].alias("locator"), o["detail"].alias("detail"), o["snippet"].alias("snippet"))


def config_nginx(spark, sf_dir):
    rows = B.text_files(spark, sf_dir, "concat('conf/p', p_partkey, '/nginx.conf')", B.NGINX_TEXT)
    return _claims(config_text.nginx_findings(rows), "endpoint", "versions", "min_version", "cipher_suites", "group", "groups", "hybrid", "path")


def config_sshd(spark, sf_dir):
    rows = B.text_files(spark, sf_dir, "concat('conf/p', p_partkey, '/sshd_config')", B.SSHD_TEXT)
    return _claims(config_text.sshd_findings(rows), "endpoint", "algorithms")


def config_openssl(spark, sf_dir):
    rows = B.text_files(spark, sf_dir, "concat('conf/p', p_partkey, '/openssl.cnf')", B.OPENSSL_TEXT)
    return _claims(config_text.openssl_findings(rows), "endpoint", "min_version", "max_version", "cipher_suites", "group", "groups", "hybrid")


def packages_dpkg(spark, sf_dir):
    rows = B.text_files(spark, sf_dir, "concat('img/p', p_partkey, '/status')", B.DPKG_TEXT)
    found = packages.package_findings(packages.dpkg_packages(rows), packages.libraries(spark), F.lit("dpkg"))
    return _claims(found, "version", "package", "package_version", "source_package", "pqc_capable")


def packages_apk(spark, sf_dir):
    rows = B.text_files(spark, sf_dir, "concat('img/p', p_partkey, '/installed')", B.APK_TEXT)
    found = packages.package_findings(packages.apk_packages(rows), packages.libraries(spark), F.lit("apk"))
    return _claims(found, "version", "package", "package_version", "source_package", "pqc_capable")


def library_join_pqc(spark, sf_dir):
    """Parts as packages: brand to ecosystem and name, size to version text."""
    rows = B.table(spark, sf_dir, "part").selectExpr(
        "case when p_size % 3 = 0 then 'pypi' else 'distro' end as ecosystem",
        "case when p_brand like '%1' then 'OpenSSL' when p_brand like '%2' then 'LibSSL3' when p_brand like '%3' then 'cryptography' else p_brand end as package",
        "concat(case p_size % 4 when 0 then 'v3.' when 1 then '1:3.' else '3.' end, p_size % 10, case when p_size % 5 = 0 then '.x' else '.7-r1+b' end) as version")
    found = packages.join_libraries(rows, packages.libraries(spark))
    capable = packages.is_pqc_capable(F.col("floor"), F.col("verified"), F.col("version"))
    return found.groupBy("ecosystem", "package", "library", "version", packages.upstream_version(F.col("version")).alias("upstream"),
                         F.array_join(packages.version_array(F.col("version")), ".").alias("numbers"), capable.alias("pqc_capable")).agg(F.count(F.lit(1)).alias("n"))


def deps_lockfile(spark, sf_dir):
    found = packages.dependency_findings(B.manifest_files(spark, sf_dir), packages.libraries(spark))
    return _claims(found, "ecosystem", "package", "version", "version_is_range", "pqc_capable")


def range_lower_bound(spark, sf_dir):
    rows = B.table(spark, sf_dir, "part").selectExpr(
        """case p_size % 7 when 0 then concat('>=', p_size, '.0,<99') when 1 then concat('^1.', p_size, '.1') when 2 then '*'
           when 3 then concat('~=', p_size, '.1') when 4 then concat(p_size, '.2,<3') when 5 then '<5' else concat('== ', p_size, '.4') end as spec""")
    return rows.groupBy("spec", packages.lower_bound(F.col("spec")).alias("lowest")).agg(F.count(F.lit(1)).alias("n"))


def detect_code(spark, sf_dir):
    """The full rule tables over generated code, annotated and folded."""
    rows = B.text_files(spark, sf_dir, "concat('svc/p', p_partkey, '.py')", B.CODE_TEXT)
    return _claims(detect.source_findings(rows), "key_size", "mode", "curve", "flagged", "candidate")


TEXT_RULES = (
    detect.DetectRule("doc-token", "text", r"\b(token) = (\"[0-9a-f]{40}\")", "unknown", "unknown", "unknown", "planted tokens",
                      asset_type="key", capture={"holder": 1}, flags=("candidate",), confidence=0.5, redact=True, min_entropy=3.0, literal_group=2),
    detect.DetectRule("doc-url", "text", r"https?://([a-z0-9.-]+)", "URL", "unknown", "unknown", "web addresses", capture={"host": 1}),
    detect.DetectRule("doc-license", "text", r"\b[Ll]icense\b", "License", "unknown", "unknown", "license lines"),
)


def detect_documents(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").selectExpr(
        "'base' as scan_id", "source as system", "concat('doc/', doc_id) as path", "text", "'text' as language")
    found = detect.matches(files.lines(B.dealt(docs, "path")), TEXT_RULES)
    return found.groupBy("path", "line_no", "rule_id", param("host").alias("host"), "holder", "confidence").agg(F.count(F.lit(1)).alias("n"))


def candidate_fold(spark, sf_dir):
    """License lines of a document confirm its tokens."""
    docs = B.table(spark, sf_dir, "documents").selectExpr(
        "'base' as scan_id", "source as system", "concat('doc/', doc_id) as path", "text", "'text' as language")
    found = detect.annotate(durable(detect.matches(files.lines(B.dealt(docs, "path")), TEXT_RULES)))
    marked = found.withColumn("holder", F.when(F.col("rule_id") == "doc-license", F.lit("token")).otherwise(F.col("holder")))
    rows = detect.fold_candidates(marked)
    return rows.groupBy("path", "algorithm", "rule_id", F.size(F.coalesce("also", F.array())).alias("sightings"), "confidence").agg(F.count(F.lit(1)).alias("n"))


def symbol_join(spark, sf_dir):
    """Words of the documents as imported symbols, versioned like linkers do."""
    docs = B.table(spark, sf_dir, "documents").select(F.lit("base").alias("scan_id"), F.col("source").alias("system"), F.col("lang").alias("path"),
                                                    F.explode(F.split("text", r"[^A-Za-z]+")).alias("word"))
    imports = docs.filter("word <> ''").withColumn("symbol", F.concat(F.col("word"), F.lit("@@V_1")))
    entries = [{"symbol": w, "library": "text", "algorithm": w.upper(), "primitive": "unknown", "usage": "unknown", "params": {}}
               for w in ("the", "License", "token", "nicht", "que", "absent")]
    return bytescan.symbol_hits(imports, bytescan.symbols(spark, entries)).select("system", "path", "symbol", "algorithm")


TEXT_SIGNATURES = tuple(bytescan.Signature("constant", n, n.encode(), n.upper()) for n in ("token = ", "http", "License", "é", "absent phrase"))


def signature_hits(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return bytescan.signature_hits(docs, TEXT_SIGNATURES).select("doc_id", "name", "offset", "algorithm")


def version_banners(spark, sf_dir):
    banners = (("license", r"Version (\d+\.\d+)"), ("creative", r"NC (\d+\.\d+)"), ("address", r"\((\d{3})\) \d{3}"))
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return bytescan.banner_hits(docs, banners).select("doc_id", "library", "version", "banner", "offset")


def pem_blocks(spark, sf_dir):
    """Whole documents followed by a PEM block: label by language."""
    docs = B.table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        """concat(text, chr(10), '-----BEGIN ', case lang when 'en' then 'RSA PRIVATE KEY' else 'CERTIFICATE' end, '-----', chr(10),
           md5(text), chr(10), '-----END ', case lang when 'en' then 'RSA PRIVATE KEY' when 'fr' then 'OTHER' else 'CERTIFICATE' end, '-----', chr(10)) as text""")
    return bytescan.pem_hits(docs).select("doc_id", "label", "fingerprint", "offset", "is_private")


def _redacted(spark, sf_dir, name, keys, text):
    rows = B.dealt(B.table(spark, sf_dir, name).select(*keys, text), keys[0])
    fixed = rows.withColumn("fixed", R.redact_text(F.col(text), True, SECRET_WORDS))
    return fixed.select(
        *keys, F.md5("fixed").alias("digest"), F.length("fixed").cast("bigint").alias("length"), (F.col("fixed") != F.col(text)).alias("changed"))


def redact_audit(spark, sf_dir):
    """Which rule acted how often in which column, never on what."""
    parts = None
    for name, key, text in (("documents", "doc_id", "text"), ("conversations", "conv_id", "text"), ("pages", "page_id", "html")):
        one = B.dealt(B.table(spark, sf_dir, name).select(key, text), key).select(F.lit(f"{name}.{text}").alias("field"), F.explode(R.rules_hit(F.col(text), True, SECRET_WORDS)).alias("rule"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("field", "rule").agg(F.count(F.lit(1)).alias("rows"))


def text_entropy(spark, sf_dir):
    return B.dealt(B.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.round(R.entropy(F.col("text")), 5).alias("bits"))


QUERIES = {
    f.__name__: f
    for f in (
        config_nginx, config_sshd, config_openssl, packages_dpkg, packages_apk, library_join_pqc, deps_lockfile, range_lower_bound,
        detect_code, detect_documents, candidate_fold, symbol_join, signature_hits, version_banners, pem_blocks, redact_audit, text_entropy,
    )
}
QUERIES.update({
    "redact_documents": partial(_redacted, name="documents", keys=("doc_id",), text="text"),
    "redact_conversations": partial(_redacted, name="conversations", keys=("conv_id", "turn"), text="text"),
    "redact_pages": partial(_redacted, name="pages", keys=("page_id",), text="html"),
})

_LINES = """f AS (SELECT concat('sys', p_partkey % 25) AS system, {path} AS path, {text} AS text FROM part),
ln AS (SELECT system, path, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM f),
code AS (SELECT system, path, n, regexp_replace(raw, '#.*$', '') AS c FROM ln)
"""
_GROUPISH = """CASE upper(trim({0})) WHEN 'P-256' THEN 'prime256v1' WHEN 'P-384' THEN 'secp384r1' WHEN 'P-521' THEN 'secp521r1'
  WHEN 'X25519' THEN 'x25519' WHEN 'X448' THEN 'x448' ELSE trim({0}) END"""
_CLAIM = "'{0}' AS asset_type, '{1}' AS primitive, {2} AS algorithm, 'unknown' AS usage, TRUE AS configurable, 1.0 AS confidence"
_GROUPS = "array_to_string(list_transform(list_filter(string_split({0}, ':'), lambda x: trim(x) <> ''), lambda x: " + _GROUPISH.format("x") + "), ',')"
_SUITES = "array_to_string(list_filter(string_split({0}, ':'), lambda x: x <> ''), ',')"

_DOC_LINES = """ln AS (SELECT doc_id, source, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS raw, generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r'), 1) AS line_no FROM documents),
hits AS (
  SELECT doc_id, source, CAST(line_no AS INTEGER) AS line_no, 'doc-token' AS rule_id, unnest(regexp_extract_all(raw, '\\btoken = "[0-9a-f]{40}"')) AS m FROM ln
  UNION ALL SELECT doc_id, source, CAST(line_no AS INTEGER), 'doc-url', unnest(regexp_extract_all(raw, 'https?://[a-z0-9.-]+')) FROM ln
  UNION ALL SELECT doc_id, source, CAST(line_no AS INTEGER), 'doc-license', unnest(regexp_extract_all(raw, '\\b[Ll]icense\\b')) FROM ln)
"""
_REDACT = """WITH t AS (SELECT {keys}, {text} AS text FROM {name}),
c AS (SELECT *, regexp_replace(text, '"(?:\\\\.|[^"\\\\\\n])*"|''(?:\\\\.|[^''\\\\\\n])*''|`(?:\\\\.|[^`\\\\\\n])*`', ' ', 'g') AS code FROM t),
w AS (SELECT * EXCLUDE (code), list_transform(regexp_extract_all(regexp_replace(code, '(?m)(^|[ \\t\\f\\v])(#|//)[ \\t\\f\\v].*$', '', 'g'), '[A-Za-z_$][A-Za-z0-9_$]*'),
        lambda i: list_transform(regexp_extract_all(i, '[A-Z]?[a-z]+[0-9]*|[A-Z]+[0-9]*|[0-9]+'), lambda x: lower(x))) AS ids FROM c),
s AS (SELECT *, len(list_filter(ids, lambda ws: list_has_any(ws, {secret}) OR (list_has_any(ws, ['key', 'keys']) AND NOT list_has_any(ws, {harmless})))) > 0 AS secret FROM w),
r AS (SELECT *, CASE WHEN secret THEN regexp_replace(text, '(["''`])[0-9a-f]{{40}}(["''`])', '\\1<redacted>\\2', 'g') ELSE text END AS fixed FROM s)
""".replace("{secret}", repr(list(SECRET_WORDS))).replace("{harmless}", repr(list(R.NOT_SECRET_WORDS)))


def _redact_oracle(name: str, keys: str, text: str) -> str:
    return _REDACT.replace("{{", "{").replace("}}", "}").replace("{keys}", keys).replace("{text}", text).replace("{name}", name) + (
        f"SELECT {keys}, md5(fixed) AS digest, length(fixed) AS length, fixed <> text AS changed FROM r")


def _redact_rows(name: str, text: str) -> str:
    inner = _REDACT.replace("{{", "{").replace("}}", "}").replace("{keys}", "1 AS k").replace("{text}", text).replace("{name}", name)
    return f"SELECT '{name}.{text}' AS field, 'secret-name' AS rule, count(*) AS rows FROM ({inner} SELECT * FROM r WHERE fixed <> text) HAVING count(*) > 0"


_LIB = """CASE lower(package) WHEN 'libssl3' THEN 'OpenSSL' WHEN 'openssl' THEN 'OpenSSL' WHEN 'libcrypto3' THEN 'OpenSSL' WHEN 'libgnutls30' THEN 'GnuTLS' END"""
_PACKAGE = """SELECT 'library' AS asset_type, 'unknown' AS primitive, {lib} AS algorithm, 'unknown' AS usage, CAST(NULL AS BOOLEAN) AS configurable, 1.0 AS confidence,
  upstream AS version, package, raw AS package_version, source AS source_package,
  CASE WHEN {lib} = 'OpenSSL' THEN CAST(list_transform(string_split(upstream, '.'), lambda x: CAST(x AS INTEGER)) >= [3, 5, 0] AS VARCHAR) END AS pqc_capable,
  path AS locator, '{detail}' AS detail, package || ' ' || raw AS snippet
FROM (SELECT *, split_part(split_part(regexp_replace(regexp_replace(raw, '^v', ''), '^[^:]*:', ''), '-', 1), '+', 1) AS upstream FROM p) WHERE {lib} IS NOT NULL"""

ORACLES = {
    "config_nginx": "WITH " + _LINES.format(path="concat('conf/p', p_partkey, '/nginx.conf')", text=B.NGINX_TEXT) + """,
        m AS (SELECT *, regexp_matches(c, '^\\s*\\w+[^{;]*\\{\\s*$') AS o, regexp_matches(c, '^\\s*\\}') AS x,
                regexp_matches(c, '^\\s*server\\s*\\{\\s*$') AS srv, regexp_extract(c, '^\\s*(\\w+)\\s+([^;]+);', 1) AS name, trim(regexp_extract(c, '^\\s*(\\w+)\\s+([^;]+);', 2)) AS value FROM code),
        d AS (SELECT *, sum(o::INT - x::INT) OVER (PARTITION BY path ORDER BY n) AS depth, sum(srv::INT) OVER (PARTITION BY path ORDER BY n) AS blk FROM m),
        i AS (SELECT * FROM d WHERE depth = 2 AND blk > 0 AND NOT o AND NOT x AND name <> ''),
        b AS (SELECT path, blk,
                coalesce(arg_min(split_part(value, ' ', 1), n) FILTER (name = 'server_name'), '') || ':' ||
                  coalesce(arg_min(regexp_extract(split_part(value, ' ', 1), '[^:]*$'), n) FILTER (name = 'listen'), '') AS endpoint,
                coalesce(bool_or(name = 'listen' AND regexp_matches(value, '\\bssl\\b')), FALSE) OR bool_or(name LIKE 'ssl\\_%' ESCAPE '\\') AS tls,
                """ + ", ".join(f"arg_max(value, n) FILTER (name = '{d}') AS {d[4:]}, max(n) FILTER (name = '{d}') AS {d[4:]}_n" for d in ("ssl_protocols", "ssl_ciphers", "ssl_ecdh_curve", "ssl_certificate")) + """
              FROM i GROUP BY ALL),
        t AS (SELECT * FROM b WHERE tls)
        SELECT """ + _CLAIM.format("protocol", "unknown", "'TLS'") + """, endpoint,
          array_to_string(string_split_regex(protocols, '\\s+'), ',') AS versions,
          list_filter(['SSLv2', 'SSLv3', 'TLSv1', 'TLSv1.1', 'TLSv1.2', 'TLSv1.3'], lambda v: list_contains(string_split_regex(protocols, '\\s+'), v))[1] AS min_version,
          """ + _SUITES.format("ciphers") + """ AS cipher_suites, NULL AS "group", NULL AS groups, NULL AS hybrid, NULL AS path,
          t.path || ':' || coalesce(protocols_n, ciphers_n) AS locator, 'nginx ssl_protocols/ssl_ciphers' AS detail, coalesce(protocols, ciphers) AS snippet
        FROM t WHERE protocols IS NOT NULL OR ciphers IS NOT NULL
        UNION ALL
        SELECT """ + _CLAIM.format("algorithm", "key-agreement", _GROUPISH.format("split_part(ecdh_curve, ':', 1)")) + """, endpoint, NULL, NULL, NULL,
          """ + _GROUPISH.format("split_part(ecdh_curve, ':', 1)") + ", " + _GROUPS.format("ecdh_curve") + """,
          CAST(contains(upper(split_part(ecdh_curve, ':', 1)), 'MLKEM') AS VARCHAR), NULL, t.path || ':' || ecdh_curve_n, 'nginx ssl_ecdh_curve', ecdh_curve
        FROM t WHERE ecdh_curve IS NOT NULL
        UNION ALL
        SELECT """ + _CLAIM.format("certificate", "unknown", "'unknown'") + """, endpoint, NULL, NULL, NULL, NULL, NULL, NULL, certificate,
          t.path || ':' || certificate_n, 'nginx ssl_certificate', certificate FROM t WHERE certificate IS NOT NULL""",
    "config_sshd": "WITH " + _LINES.format(path="concat('conf/p', p_partkey, '/sshd_config')", text=B.SSHD_TEXT) + """,
        k AS (SELECT *, lower(regexp_extract(c, '^\\s*([A-Za-z][A-Za-z0-9]*)\\s', 1)) AS kw, trim(regexp_extract(c, '^\\s*[A-Za-z][A-Za-z0-9]*\\s+(.*)$', 1)) AS v FROM code),
        fst AS (SELECT system, path, kw, min(n) AS n, arg_min(v, n) AS v FROM k WHERE kw IN ('kexalgorithms', 'ciphers', 'macs', 'hostkeyalgorithms') GROUP BY ALL)
        SELECT 'algorithm' AS asset_type, CASE kw WHEN 'kexalgorithms' THEN 'key-agreement' WHEN 'ciphers' THEN 'block-cipher' WHEN 'macs' THEN 'mac' ELSE 'signature' END AS primitive,
          CASE kw WHEN 'kexalgorithms' THEN 'SSH-KEX' WHEN 'ciphers' THEN 'SSH-CIPHERS' WHEN 'macs' THEN 'SSH-MACS' ELSE 'SSH-HOSTKEY' END AS algorithm,
          'unknown' AS usage, TRUE AS configurable, 1.0 AS confidence, 'sshd@' || system AS endpoint, v AS algorithms, path || ':' || n AS locator, 'sshd_config' AS detail, v AS snippet FROM fst""",
    "config_openssl": "WITH " + _LINES.format(path="concat('conf/p', p_partkey, '/openssl.cnf')", text=B.OPENSSL_TEXT) + """,
        k AS (SELECT *, nullif(lower(trim(regexp_extract(c, '^\\s*\\[\\s*([^\\]]+?)\\s*\\]', 1))), '') AS sec,
                lower(regexp_extract(c, '^\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*=', 1)) AS kw, trim(regexp_extract(c, '=\\s*(.*)$', 1)) AS v FROM code),
        p AS (SELECT *, last_value(sec IGNORE NULLS) OVER (PARTITION BY path ORDER BY n) AS cur FROM k),
        g AS (SELECT system, path, """ + ", ".join(f"arg_max(v, n) FILTER (kw = '{d}') AS {d}, max(n) FILTER (kw = '{d}') AS {d}_n" for d in ("groups", "cipherstring", "ciphersuites", "minprotocol", "maxprotocol")) + """
              FROM p WHERE cur = 'system_default_sect' AND kw <> '' GROUP BY ALL)
        SELECT """ + _CLAIM.format("algorithm", "key-agreement", _GROUPISH.format("split_part(groups, ':', 1)")) + """, 'openssl@' || system AS endpoint, NULL AS min_version, NULL AS max_version, NULL AS cipher_suites,
          """ + _GROUPISH.format("split_part(groups, ':', 1)") + """ AS "group", """ + _GROUPS.format("groups") + """ AS groups, CAST(contains(upper(split_part(groups, ':', 1)), 'MLKEM') AS VARCHAR) AS hybrid,
          path || ':' || groups_n AS locator, 'openssl.cnf Groups' AS detail, groups AS snippet FROM g WHERE groups IS NOT NULL
        UNION ALL
        SELECT """ + _CLAIM.format("protocol", "unknown", "'TLS'") + """, 'openssl@' || system, minprotocol, maxprotocol, """ + _SUITES.format("coalesce(cipherstring, ciphersuites)") + """, NULL, NULL, NULL,
          path || ':' || coalesce(minprotocol_n, maxprotocol_n, cipherstring_n, ciphersuites_n), 'openssl.cnf system_default_sect', coalesce(minprotocol, maxprotocol, cipherstring, ciphersuites)
        FROM g WHERE coalesce(minprotocol, maxprotocol, cipherstring, ciphersuites) IS NOT NULL""",
    "packages_dpkg": "WITH " + """p AS (SELECT concat('img/p', p_partkey, '/status') AS path, CASE p_size % 4 WHEN 0 THEN 'libssl3' WHEN 1 THEN 'libgnutls30' WHEN 2 THEN 'OpenSSL' ELSE 'bash' END AS package,
          concat(CASE p_size % 3 WHEN 0 THEN '1:3.' ELSE '3.' END, p_size % 8, '.', p_partkey % 20, '-0ubuntu1') AS raw, CASE WHEN p_size % 2 = 0 THEN 'openssl' END AS source
          FROM part WHERE p_size % 9 <> 0) """ + _PACKAGE.format(lib=_LIB, detail="dpkg"),
    "packages_apk": "WITH " + """p AS (SELECT concat('img/p', p_partkey, '/installed') AS path, 'libcrypto3' AS package, concat('3.', p_size % 8, '.', p_partkey % 10, '-r0') AS raw, 'openssl' AS source
          FROM part WHERE p_size % 3 = 0) """ + _PACKAGE.format(lib=_LIB, detail="apk"),
    "library_join_pqc": """WITH p AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'pypi' ELSE 'distro' END AS ecosystem,
          CASE WHEN p_brand LIKE '%1' THEN 'OpenSSL' WHEN p_brand LIKE '%2' THEN 'LibSSL3' WHEN p_brand LIKE '%3' THEN 'cryptography' ELSE p_brand END AS package,
          concat(CASE p_size % 4 WHEN 0 THEN 'v3.' WHEN 1 THEN '1:3.' ELSE '3.' END, p_size % 10, CASE WHEN p_size % 5 = 0 THEN '.x' ELSE '.7-r1+b' END) AS version,
          concat('3.', p_size % 10, CASE WHEN p_size % 5 = 0 THEN '.x' ELSE '.7' END) AS upstream,
          concat('3.', p_size % 10, CASE WHEN p_size % 5 = 0 THEN '' ELSE '.7' END) AS numbers,
          CASE WHEN p_size % 5 = 0 THEN [3, p_size % 10] ELSE [3, p_size % 10, 7] END AS v FROM part)
        SELECT ecosystem, package, CASE WHEN ecosystem = 'distro' THEN 'OpenSSL' ELSE 'cryptography' END AS library, version, upstream, numbers,
          CASE WHEN ecosystem = 'distro' THEN v >= [3, 5, 0] END AS pqc_capable, count(*) AS n
        FROM p WHERE (ecosystem = 'distro' AND package IN ('OpenSSL', 'LibSSL3')) OR (ecosystem = 'pypi' AND package = 'cryptography') GROUP BY ALL""",
    "deps_lockfile": """WITH d AS (
          SELECT p_partkey, 'pypi' AS ecosystem, 'cryptography' AS package, 'cryptography' AS lib, concat('43.0.', p_partkey % 9) AS version, FALSE AS r, 'poetry.lock' AS file FROM part WHERE p_size % 3 = 0
          UNION ALL SELECT p_partkey, 'pypi', 'cryptography', 'cryptography', CASE WHEN p_size % 2 = 0 THEN concat('42.0.', p_partkey % 9) ELSE '>=41.0,<43' END, p_size % 2 <> 0, 'requirements.txt' FROM part WHERE p_size % 3 <> 0
          UNION ALL SELECT p_partkey, 'pypi', 'PyJWT', 'PyJWT', '2.8.0', FALSE, 'requirements.txt' FROM part WHERE p_size % 3 <> 0
          UNION ALL SELECT p_partkey, 'go', 'golang.org/x/crypto', 'golang.org/x/crypto', concat('v0.', p_size, '.0'), FALSE, 'go.mod' FROM part WHERE p_size % 4 = 0
          UNION ALL SELECT p_partkey, 'npm', 'node-forge', 'node-forge', concat('^1.', p_size % 4, '.1'), TRUE, 'package.json' FROM part WHERE p_size % 5 < 3
          UNION ALL SELECT p_partkey, 'npm', 'elliptic', 'elliptic', concat('6.5.', p_size % 6), FALSE, 'package.json' FROM part WHERE p_size % 5 < 3)
        SELECT 'library' AS asset_type, 'unknown' AS primitive, lib AS algorithm, 'unknown' AS usage, CAST(NULL AS BOOLEAN) AS configurable, CASE WHEN r THEN 0.7 ELSE 1.0 END AS confidence,
          ecosystem, package, version, CASE WHEN r THEN 'true' END AS version_is_range, CAST(NULL AS VARCHAR) AS pqc_capable,
          concat('repo/p', p_partkey, '/', file) AS locator, 'manifest=' || file AS detail, package || ' ' || version AS snippet FROM d""",
    "range_lower_bound": """SELECT spec, lowest, count(*) AS n FROM (SELECT
          CASE p_size % 7 WHEN 0 THEN concat('>=', p_size, '.0,<99') WHEN 1 THEN concat('^1.', p_size, '.1') WHEN 2 THEN '*' WHEN 3 THEN concat('~=', p_size, '.1')
            WHEN 4 THEN concat(p_size, '.2,<3') WHEN 5 THEN '<5' ELSE concat('== ', p_size, '.4') END AS spec,
          CASE p_size % 7 WHEN 0 THEN concat(p_size, '.0') WHEN 1 THEN concat('1.', p_size, '.1') WHEN 3 THEN concat(p_size, '.1') WHEN 4 THEN concat(p_size, '.2')
            WHEN 6 THEN concat(p_size, '.4') END AS lowest FROM part) GROUP BY ALL""",
    "detect_code": """WITH c AS (SELECT *, concat('svc/p', p_partkey, '.py') AS path, 2 + (p_size % 5 = 0)::INT + (p_size % 10 = 0)::INT + (p_size % 7 = 0)::INT AS last FROM part),
        d AS (
          SELECT path, 2 AS line, 'py-rsa-keygen' AS rule, 'algorithm' AS asset_type, 'pke' AS primitive, 'RSA' AS algorithm, 'unknown' AS usage, FALSE AS configurable, 1.0 AS confidence,
            CAST(1024 * (1 + p_size % 4) AS VARCHAR) AS key_size, NULL AS mode, NULL AS curve, NULL AS flagged, NULL AS candidate,
            concat('key = rsa.generate_private_key(public_exponent=65537, key_size=', 1024 * (1 + p_size % 4), ')') AS snippet FROM c WHERE p_size % 6 = 0
          UNION ALL SELECT path, 2, 'py-rsa-keygen', 'algorithm', 'pke', 'RSA', 'unknown', TRUE, 0.6, 'bits', NULL, NULL, NULL, NULL, 'key = rsa.generate_private_key(public_exponent=65537, key_size=bits)' FROM c WHERE p_size % 6 = 1
          UNION ALL SELECT path, 2, 'py-hashlib-md5', 'algorithm', 'hash', 'MD5', 'hash', FALSE, 1.0, NULL, NULL, NULL, NULL, NULL, 'digest = hashlib.md5(data).hexdigest()' FROM c WHERE p_size % 6 = 2
          UNION ALL SELECT path, 2, 'py-aes-cipher', 'algorithm', 'block-cipher', 'AES', 'encrypt', NOT TRUE, 1.0, NULL, 'ECB', NULL, 'true', NULL, 'c = Cipher(algorithms.AES(k), modes.ECB())' FROM c WHERE p_size % 6 = 3
          UNION ALL SELECT path, 2, 'py-hardcoded-cipher-key', 'key', 'unknown', 'AES', 'unknown', FALSE, 1.0, NULL, NULL, NULL, 'true', NULL, '<redacted key material>' FROM c WHERE p_size % 6 = 3
          UNION ALL SELECT path, 2, 'py-ec-keygen', 'algorithm', 'key-agreement', 'ECDH', 'unknown', FALSE, 1.0, NULL, NULL, 'SECP256R1', NULL, NULL, 'curve = ec.generate_private_key(ec.SECP256R1())' FROM c WHERE p_size % 6 = 4
          UNION ALL SELECT path, 3, 'py-hardcoded-key-candidate', 'key', 'unknown', 'unknown', 'unknown', FALSE, 0.5, NULL, NULL, NULL,
            NULL, 'true', '<redacted key material>' FROM c WHERE p_size % 5 = 0 AND p_size % 10 <> 0
          UNION ALL SELECT path, 4, 'py-hardcoded-cipher-key', 'key', 'unknown', 'AES', 'unknown', FALSE, 1.0, NULL, NULL, NULL, 'true', NULL, '<redacted key material>' FROM c WHERE p_size % 10 = 0
          UNION ALL SELECT path, 4, 'py-aes-cipher-pycryptodome', 'algorithm', 'block-cipher', 'AES', 'encrypt', FALSE, 1.0, NULL, 'CBC', NULL, NULL, NULL, 'cipher = AES.new(API_KEY, AES.MODE_CBC)' FROM c WHERE p_size % 10 = 0
          UNION ALL SELECT path, last, 'py-rsa-keygen', 'algorithm', 'pke', 'RSA', 'sign', TRUE, 1.0, 'int', NULL, NULL, NULL, NULL, 'k2 = rsa.generate_private_key(key_size=int(os.environ["BITS"])).sign(data)' FROM c WHERE p_size % 7 = 0)
        SELECT asset_type, primitive, algorithm, usage, configurable, confidence, key_size, mode, curve, flagged, candidate, path || ':' || line AS locator, 'rule=' || rule AS detail, snippet FROM d""",
    "detect_documents": "WITH " + _DOC_LINES + """
        SELECT 'doc/' || doc_id AS path, line_no, rule_id, CASE rule_id WHEN 'doc-url' THEN regexp_replace(m, '^https?://', '') END AS host,
          CASE rule_id WHEN 'doc-token' THEN 'token' END AS holder,
          CASE rule_id WHEN 'doc-token' THEN 0.5 WHEN 'doc-url' THEN CASE WHEN contains(m, '.') THEN 1.0 ELSE 0.6 END ELSE 1.0 END AS confidence, count(*) AS n
        FROM hits GROUP BY ALL""",
    "candidate_fold": "WITH " + _DOC_LINES + """,
        lic AS (SELECT DISTINCT doc_id FROM hits WHERE rule_id = 'doc-license'),
        tok AS (SELECT doc_id, count(DISTINCT line_no) AS k FROM hits WHERE rule_id = 'doc-token' GROUP BY ALL)
        SELECT 'doc/' || h.doc_id AS path, CASE rule_id WHEN 'doc-token' THEN 'unknown' WHEN 'doc-url' THEN 'URL' ELSE 'License' END AS algorithm, rule_id,
          CAST(CASE rule_id WHEN 'doc-license' THEN coalesce(k, 0) ELSE 0 END AS INTEGER) AS sightings,
          CASE rule_id WHEN 'doc-token' THEN 0.5 WHEN 'doc-url' THEN CASE WHEN contains(m, '.') THEN 1.0 ELSE 0.6 END ELSE 1.0 END AS confidence, count(*) AS n
        FROM hits h LEFT JOIN tok ON tok.doc_id = h.doc_id WHERE NOT (rule_id = 'doc-token' AND h.doc_id IN (SELECT doc_id FROM lic)) GROUP BY ALL""",
    "symbol_join": """SELECT DISTINCT source AS system, lang AS path, w AS symbol, upper(w) AS algorithm
        FROM (SELECT source, lang, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) WHERE w IN ('the', 'License', 'token', 'nicht', 'que', 'absent')""",
    "signature_hits": """SELECT doc_id, s AS name, octet_length(encode(left(text, instr(text, s) - 1))) AS "offset", CASE WHEN s = 'é' THEN 'É' ELSE upper(s) END AS algorithm
        FROM documents, (SELECT unnest(['token = ', 'http', 'License', 'é', 'absent phrase']) AS s) WHERE instr(text, s) > 0""",
    "version_banners": """SELECT doc_id, l AS library, regexp_extract(text, p, 1) AS version, regexp_extract(text, p) AS banner,
          octet_length(encode(left(text, instr(text, regexp_extract(text, p)) - 1))) AS "offset"
        FROM documents, (SELECT * FROM (VALUES ('license', 'Version ([0-9]+\\.[0-9]+)'), ('creative', 'NC ([0-9]+\\.[0-9]+)'), ('address', '\\(([0-9]{3})\\) [0-9]{3}')) v(l, p)) WHERE regexp_matches(text, p)""",
    "pem_blocks": """WITH d AS (SELECT doc_id, lang, length(text) + 1 AS o, CASE lang WHEN 'en' THEN 'RSA PRIVATE KEY' ELSE 'CERTIFICATE' END AS label, md5(text) AS body FROM documents WHERE lang <> 'fr')
        SELECT doc_id, label, left(sha256('-----BEGIN ' || label || '-----' || chr(10) || body || chr(10) || '-----END ' || label || '-----'), 32) AS fingerprint, o AS "offset", lang = 'en' AS is_private FROM d""",
    "redact_documents": _redact_oracle("documents", "doc_id", "text"),
    "redact_conversations": _redact_oracle("conversations", "conv_id, turn", "text"),
    "redact_pages": _redact_oracle("pages", "page_id", "html"),
    "redact_audit": " UNION ALL ".join(f"({_redact_rows(n, t)})" for n, t in (("documents", "text"), ("conversations", "text"), ("pages", "html"))),
    "text_entropy": """WITH ch AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY ALL),
        tot AS (SELECT doc_id, sum(n) AS t FROM ch GROUP BY ALL)
        SELECT doc_id, round(-sum(n / t * log2(n / t)), 5) AS bits FROM ch JOIN tot USING (doc_id) GROUP BY ALL""",
}
