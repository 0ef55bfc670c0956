"""The derived inventory inputs again, written independently as ANSI SQL.

Used only to check answers: nothing in the library runs these strings.
"""

FINDINGS = """
src AS (
  SELECT l.*, p_name, p_size % 4 AS ps, s_nationkey,
         CAST(l_partkey % 16 AS INTEGER) AS i,
         CAST((l_partkey // 16) % 3 AS VARCHAR) AS place,
         CASE WHEN (l_suppkey + l_linenumber) % 3 = 0 OR ((l_suppkey + l_linenumber) % 3 = 2 AND s_nationkey = 24) OR ((l_suppkey + l_linenumber) % 3 = 1 AND s_nationkey = 23) THEN 'declared' WHEN (l_suppkey + l_linenumber) % 3 = 1 THEN 'shipped' ELSE 'observed' END AS view
  FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
),
wide AS (
  SELECT *,
    CASE WHEN l_linestatus = 'O' THEN 'base' ELSE 'head' END AS scan_id,
    'sys' || s_nationkey AS system,
    CASE WHEN view = 'declared' THEN ['source','config','deps'][l_linenumber % 3 + 1]
         WHEN view = 'shipped' THEN ['container','binary'][l_linenumber % 2 + 1] ELSE 'runtime-spool' END AS scanner_id,
    ['RSA','ECDSA','Ed25519','ECDH','AES','ChaCha20-Poly1305','SHA-1','SHA-256','MD5','3DES','ML-KEM',
     'X25519MLKEM768','x25519','TLS','OpenSSL','TLS_AES_256_GCM_SHA384'][i + 1] AS algorithm,
    CASE WHEN i = 0 THEN 'pke' WHEN i IN (1, 2) THEN 'signature' WHEN i IN (3, 12) THEN 'key-agreement'
         WHEN i IN (4, 9) THEN 'block-cipher' WHEN i = 5 THEN 'stream-cipher' WHEN i IN (6, 7, 8) THEN 'hash'
         WHEN i IN (10, 11) THEN 'kem' ELSE 'unknown' END AS primitive,
    CASE i WHEN 13 THEN 'protocol' WHEN 14 THEN 'library' ELSE 'algorithm' END AS asset_type,
    CASE WHEN i NOT IN (0, 4) THEN NULL WHEN l_suppkey % 11 = 0 THEN 'unknown'
         WHEN l_suppkey % 5 = 0 THEN '  ' || (CASE i WHEN 0 THEN ['1024','2048','3072',NULL] ELSE ['128','192','256',NULL] END)[ps + 1] || ' '
         ELSE (CASE i WHEN 0 THEN ['1024','2048','3072',NULL] ELSE ['128','192','256',NULL] END)[ps + 1] END AS key_size,
    CASE WHEN i IN (1, 3) THEN ['prime256v1','secp256r1','P-256','p256'][ps + 1] END AS curve,
    CASE i WHEN 13 THEN ['TLSv1_2','tlsv1.2','TLSv1.3'][l_linenumber % 3 + 1]
           WHEN 14 THEN ['3.0.2-0ubuntu1','3.5.0','1:3.4.1-r2','v3.5.7'][ps + 1] END AS version,
    CASE WHEN (view = 'declared' AND l_linenumber % 3 = 1 AND l_linenumber <> 7) OR (view = 'observed' AND l_linenumber = 1)
         THEN 'ep' || (l_suppkey % 4) || ':443' END AS endpoint,
    CASE WHEN view = 'observed' AND s_nationkey % 5 = 3 THEN NULL WHEN i = 11 THEN 'X25519MLKEM768'
         WHEN i = 12 THEN 'x25519' END AS grp,
    CASE WHEN i = 11 THEN ['true','yes',NULL,'false'][ps + 1] WHEN i = 12 AND ps = 0 THEN 'false' END AS hybrid,
    CASE WHEN i = 14 THEN ['false','true','no',NULL][ps + 1] END AS pqc_capable,
    CASE WHEN i = 13 AND view = 'declared' THEN ['TLSv1.3','TLSv1.2',NULL][l_linenumber % 3 + 1] END AS min_version,
    CASE WHEN i = 15 AND view = 'declared' THEN ['TLS_AES_256_GCM_SHA384',
         'TLS_CHACHA20_POLY1305_SHA256, TLS_AES_256_GCM_SHA384','',NULL][ps + 1] END AS cipher_suites,
    CASE WHEN i = 15 AND view = 'observed' THEN ['TLS_AES_128_GCM_SHA256','TLS_AES_256_GCM_SHA384',
         'TLS_CHACHA20_POLY1305_SHA256',NULL][ps + 1] END AS cipher_suite,
    CASE WHEN i IN (11, 12, 13) AND view = 'observed' THEN ['full','partial','none'][l_linenumber % 3 + 1] END AS enrichment,
    CASE WHEN l_suppkey % 10 = 3 THEN 'ssh-server' END AS role,
    CASE WHEN i <= 3 THEN ['sign','key-transport','unknown'][l_linenumber % 3 + 1] WHEN i IN (4, 5, 9) THEN 'encrypt'
         WHEN i IN (6, 7, 8) THEN 'hash' WHEN i IN (10, 11, 12) THEN 'key-exchange' ELSE 'unknown' END AS usage,
    CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END AS configurable,
    CASE WHEN view = 'observed' THEN 'host:h' || place || ':pid' || (l_orderkey % 1000)
         ELSE 'svc/f' || place || '.py:' || l_linenumber END AS locator,
    'rule=r' || i AS detail,
    CASE WHEN view = 'observed' THEN ['nginx','envoy','curl','java'][l_suppkey % 4 + 1] || ' via /usr/lib/libssl.so.3'
         ELSE p_name END AS snippet,
    1.0 - l_discount AS confidence
  FROM src
)
"""

IDENTIFIED = FINDINGS + """,
canon AS (
  SELECT * REPLACE (
      CASE WHEN regexp_full_match(trim(key_size), '[+-]?[0-9]+') THEN CAST(CAST(trim(key_size) AS BIGINT) AS VARCHAR) ELSE key_size END AS key_size,
      CASE WHEN lower(trim(curve)) IN ('prime256v1', 'secp256r1', 'p-256', 'p256', 'nistp256') THEN 'P-256' ELSE curve END AS curve,
      CASE WHEN regexp_full_match(version, '(?i)(TLS|SSL)V?[0-9]+[._][0-9]+')
           THEN upper(regexp_extract(version, '(?i)^(TLS|SSL)', 1)) || 'v' || replace(regexp_extract(version, '[0-9]+[._][0-9]+$'), '_', '.')
           ELSE version END AS version,
      CASE WHEN lower(hybrid) IN ('true', 'yes', '1', 'on') THEN 'true' WHEN lower(hybrid) IN ('false', 'no', '0', 'off') THEN 'false' ELSE hybrid END AS hybrid,
      CASE WHEN lower(pqc_capable) IN ('true', 'yes', '1', 'on') THEN 'true' WHEN lower(pqc_capable) IN ('false', 'no', '0', 'off') THEN 'false' ELSE pqc_capable END AS pqc_capable
    ),
    CASE WHEN view = 'observed' THEN regexp_replace(locator, ':pid[0-9]+$', '') ELSE regexp_replace(locator, ':[0-9]+$', '') END AS artefact
  FROM wide
),
ident AS (
  SELECT *, md5(concat_ws(chr(31), algorithm, asset_type, system, artefact,
      concat_ws(chr(30), 'cipher_suite=' || cipher_suite, 'cipher_suites=' || cipher_suites, 'curve=' || curve,
        'endpoint=' || endpoint, 'enrichment=' || enrichment, 'group=' || grp, 'hybrid=' || hybrid,
        'key_size=' || key_size, 'min_version=' || min_version, 'pqc_capable=' || pqc_capable,
        'role=' || role, 'version=' || version),
      primitive, usage)) AS bom_ref
  FROM canon
)
"""

COMPONENTS = IDENTIFIED + """,
comp AS (
  SELECT *,
    CASE WHEN asset_type = 'protocol' THEN concat_ws(' ', algorithm, nullif(version, ''))
         WHEN asset_type IN ('library', 'module', 'service') THEN algorithm
         WHEN regexp_full_match(key_size, '-?[0-9]+') THEN algorithm || '-' || key_size
         WHEN curve <> '' THEN algorithm || '-' || curve ELSE algorithm END AS name,
    CASE WHEN asset_type = 'algorithm' THEN
      CASE WHEN algorithm = 'AES' AND key_size = '128' THEN 1 WHEN algorithm = 'AES' AND key_size = '192' THEN 3
           WHEN algorithm = 'AES' AND key_size = '256' THEN 5 WHEN algorithm IN ('SHA-256', 'SHA3-256') AND key_size IS NULL THEN 2
           WHEN upper(algorithm) IN ('RSA','DSA','DH','DHE','ECDH','ECDHE','ECDSA','EDDSA','ED25519','ED448','ELGAMAL') THEN 0 END END AS nist_level,
    CASE WHEN algorithm = 'AES' AND asset_type = 'algorithm' AND key_size IN ('128', '192', '256') THEN CAST(key_size AS INTEGER) END AS classical_level,
    TRY_CAST(CASE WHEN regexp_full_match(key_size, '-?[0-9]+') THEN key_size END AS BIGINT) AS bits
  FROM (
    SELECT scan_id, system, bom_ref, asset_type, primitive, algorithm, usage, artefact, key_size, curve, version, endpoint,
           grp, hybrid, pqc_capable, min_version, cipher_suites, cipher_suite, enrichment, role,
           max(confidence) AS confidence, count(*) AS n_findings,
           CASE WHEN bool_or(configurable = FALSE) THEN FALSE WHEN bool_or(configurable = TRUE) THEN TRUE END AS configurable,
           array_to_string(list_sort(list(DISTINCT view)), ',') AS views
    FROM ident GROUP BY ALL
  )
)
"""

TARGETS = """,
targets AS (
  SELECT scan_id, 'sys' || n_nationkey AS system,
    ['government','strategic','defence','power','telecom','transport','bfsi','other'][n_nationkey % 8 + 1] AS sector,
    ['internet','internal','build','unknown','internet'][n_regionkey + 1] AS exposure,
    ['Public',' internal ','IP','health','not-listed'][n_nationkey % 5 + 1] AS data_class
  FROM nation, (SELECT unnest(['base', 'head']) AS scan_id)
)
"""

#: ``vz`` carries a horizon column z so that sweeps can reuse the same text.
INPUTS = COMPONENTS + TARGETS + """,
inputs AS (
  SELECT comp.*, coalesce(sector, 'other') AS sector, coalesce(exposure, 'unknown') AS exposure,
    CASE lower(trim(data_class)) WHEN 'public' THEN 'Public' WHEN 'internal' THEN 'Internal' WHEN 'ip' THEN 'Confidential'
         WHEN 'health' THEN 'Personal' END AS data_class,
    CASE lower(trim(data_class)) WHEN 'public' THEN 0 WHEN 'internal' THEN 3 WHEN 'ip' THEN 10 WHEN 'health' THEN 25 END AS x,
    CASE WHEN configurable = FALSE THEN 5 ELSE 3 END AS y
  FROM comp LEFT JOIN targets USING (scan_id, system)
)
"""


def scored(horizons: str = "SELECT 11 AS z") -> str:
    """CTEs ending in ``verdict``: every rule written out again as SQL."""
    asym = "('RSA','DSA','DH','DHE','ECDH','ECDHE','ECDSA','EdDSA','Ed25519','Ed448','X25519','X448','ElGamal')"
    ciphers = "('AES','Camellia','ARIA','SEED','CAST','CAST5','RC5','IDEA')"
    named = "('AES-128','Camellia-128','ARIA-128','SEED','CAST-128')"
    cii = "('government','strategic','defence','power','telecom','transport','bfsi')"
    return INPUTS + f""",
horizon AS ({horizons}),
facts AS (
  SELECT inputs.*, z,
    algorithm IN {asym} AS q_asym,
    coalesce(nist_level = 0, FALSE) AS q_level,
    algorithm IN ('RSA','DSA','ECDSA','EdDSA','Ed25519','Ed448') AND usage IN ('sign', 'verify') AS q_sig,
    algorithm IN ('RSA','DH','DHE','ECDH','ECDHE','X25519','X448','ElGamal') AND usage IN ('key-transport', 'key-exchange', 'decrypt') AS q_kem,
    algorithm IN {asym} AND usage NOT IN ('sign', 'verify', 'key-transport', 'key-exchange', 'decrypt') AS q_any,
    algorithm IN ('AES-256','SHA-384','SHA-512','SHA3-384','SHA3-512','ChaCha20','ChaCha20-Poly1305') AS q_ok,
    coalesce(algorithm = 'AES' AND bits >= 256, FALSE) AS q_ok_size,
    algorithm IN ('MD5','MD4','SHA-1','DES','RC4','ARC4','RC2','Blowfish','MD5-SHA1') AS q_now,
    algorithm IN ('ML-KEM','ML-DSA','SLH-DSA','Kyber','Dilithium','SPHINCS+','FN-DSA','Falcon') AS q_pqc,
    coalesce(algorithm IN ('RSA','DSA','DH','DHE') AND bits <= 3072, FALSE) AS n_112,
    coalesce(algorithm IN {ciphers} AND bits <= 128, FALSE) AS s_short,
    algorithm IN {named} AS s_named,
    algorithm IN ('3DES','TripleDES','DESede') AS s_legacy,
    coalesce(algorithm IN {ciphers} AND bits >= 256, FALSE) AS s_long,
    coalesce(algorithm = 'AES' AND bits <= 128, FALSE) AS d_uplift,
    asset_type IN ('library', 'module', 'service') AS d_soft,
    x + y - z AS gap
  FROM inputs, horizon
),
status AS (
  SELECT *,
    CASE WHEN q_asym OR q_level THEN 'broken'
         WHEN (s_short OR s_named) AND (x IS NULL OR x >= 10) THEN 'weakened'
         WHEN q_ok OR q_ok_size THEN 'adequate' WHEN q_pqc THEN 'pqc' END AS quantum_status
  FROM facts
),
parts AS (
  SELECT *,
    quantum_status = 'broken' AND sector IN {cii} AS d_cii,
    coalesce(quantum_status = 'broken', FALSE) AS d_all,
    CASE WHEN q_asym OR q_level OR q_ok OR q_ok_size OR q_now OR q_pqc OR n_112 OR q_sig OR q_kem OR q_any THEN
      least(40, 40 * q_asym::INT + 40 * q_level::INT + 5 * q_ok::INT + 5 * q_ok_size::INT + 40 * q_now::INT) END AS c_quantum,
    CASE WHEN x IS NULL OR gap <= 0 THEN 0 ELSE least(30, (30 * gap) // 20) END AS c_mosca,
    CASE exposure WHEN 'internet' THEN 10 WHEN 'internal' THEN 5 WHEN 'build' THEN 2 END AS c_exposure,
    CASE WHEN s_short OR s_named OR s_legacy OR s_long THEN least(25,
      (s_short::INT + s_named::INT) * (CASE WHEN x >= 25 THEN 25 WHEN x >= 10 OR x IS NULL THEN 12 ELSE 0 END)
      + 25 * s_legacy::INT) END AS c_symmetric
  FROM status
),
verdict AS (
  SELECT *,
    CASE WHEN d_all OR d_uplift OR d_soft THEN CASE WHEN coalesce(d_cii, FALSE) THEN 20 ELSE 0 END END AS c_criticality,
    coalesce(c_quantum, 0) + c_mosca + coalesce(c_exposure, 0) + coalesce(c_symmetric, 0)
      + CASE WHEN coalesce(d_cii, FALSE) THEN 20 ELSE 0 END AS score,
    CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 60 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS band,
    least(CASE WHEN q_asym THEN DATE '2035-01-01' END, CASE WHEN q_now THEN DATE '2026-01-01' END,
      CASE WHEN n_112 THEN DATE '2030-01-01' END, CASE WHEN coalesce(d_cii, FALSE) THEN DATE '2027-12-31' END,
      CASE WHEN d_all THEN DATE '2029-12-31' END, CASE WHEN s_legacy THEN DATE '2023-01-01' END,
      CASE WHEN (s_short OR s_named) AND x >= 25 THEN DATE '2030-01-01' END,
      CASE WHEN (s_short OR s_named) AND (x IS NULL OR x BETWEEN 10 AND 24) THEN DATE '2035-01-01' END) AS deadline,
    array_to_string(list_sort(list_distinct(list_filter([
      CASE WHEN q_asym OR q_level THEN 'shor-broken' END, CASE WHEN q_asym THEN 'quantum-vulnerable' END,
      CASE WHEN q_sig THEN 'target-ml-dsa' END, CASE WHEN q_kem THEN 'target-ml-kem' END,
      CASE WHEN q_kem THEN 'harvest-now-decrypt-later' END, CASE WHEN q_any THEN 'target-depends-on-usage' END,
      CASE WHEN q_ok OR q_ok_size OR s_long THEN 'quantum-adequate' END, CASE WHEN q_now THEN 'broken-today' END,
      CASE WHEN q_now OR s_legacy THEN 'classically-broken' END, CASE WHEN q_pqc THEN 'post-quantum' END,
      CASE WHEN n_112 THEN 'nist-disallowed-2035' END, CASE WHEN n_112 THEN 'nist-deprecated-2030' END,
      CASE exposure WHEN 'internet' THEN 'internet-reachable' WHEN 'internal' THEN 'internal-only' WHEN 'build' THEN 'build-time-only' END,
      CASE WHEN coalesce(d_cii, FALSE) THEN 'CII' END, CASE WHEN coalesce(d_cii, FALSE) THEN 'dst-cii-priority' END,
      CASE WHEN coalesce(d_cii, FALSE) THEN 'dst-cii-foundations' END, CASE WHEN d_all THEN 'dst-full-adoption' END,
      CASE WHEN d_uplift THEN 'dst-aes-uplift' END, CASE WHEN d_soft THEN 'assurance:L2A' END,
      CASE WHEN x IS NULL THEN 'mosca-data-lifetime-unknown' ELSE 'mosca-assessed' END,
      CASE WHEN (s_short OR s_named) AND (x IS NULL OR x >= 10) THEN 'grover-weakened' END,
      CASE WHEN (s_short OR s_named) AND x >= 25 THEN 'long-lived-data' END,
      CASE WHEN (s_short OR s_named) AND x IS NULL THEN 'data-lifetime-unknown' END,
      CASE WHEN (s_short OR s_named) AND x <= 9 THEN 'acceptable-for-lifetime' END,
      CASE WHEN s_legacy THEN 'legacy-cipher' END], lambda v: v IS NOT NULL))), ',') AS labels,
    array_to_string(list_sort(list_filter([
      CASE WHEN q_asym THEN 'quantum-shor-broken-asymmetric' END, CASE WHEN q_sig THEN 'quantum-target-signature' END,
      CASE WHEN q_kem THEN 'quantum-target-kem' END, CASE WHEN q_any THEN 'quantum-target-unknown-usage' END,
      CASE WHEN q_level THEN 'quantum-shor-broken-by-nist-level' END, CASE WHEN q_ok THEN 'quantum-adequate-symmetric-and-hash' END,
      CASE WHEN q_ok_size THEN 'quantum-adequate-aes-256-by-key-size' END, CASE WHEN q_now THEN 'quantum-classically-broken' END,
      CASE WHEN q_pqc THEN 'quantum-post-quantum-approved' END,
      CASE WHEN x IS NULL THEN 'mosca-data-lifetime-unknown' ELSE 'mosca-harvest-now-decrypt-later' END,
      CASE WHEN coalesce(d_cii, FALSE) THEN 'dst-cii-priority-migration' END, CASE WHEN coalesce(d_cii, FALSE) THEN 'dst-cii-foundations-inventory' END,
      CASE WHEN d_all THEN 'dst-full-adoption' END, CASE WHEN d_uplift THEN 'dst-aes-128-uplift' END,
      CASE WHEN d_soft THEN 'dst-assurance-software-l2a' END, CASE WHEN n_112 THEN 'nist-112-bit-asymmetric-deprecated' END,
      CASE exposure WHEN 'internet' THEN 'exposure-internet-reachable' WHEN 'internal' THEN 'exposure-internal-only' WHEN 'build' THEN 'exposure-build-time-only' END,
      CASE WHEN s_short AND x >= 25 THEN 'symmetric-grover-weakened-long-lived' END,
      CASE WHEN s_named AND x >= 25 THEN 'symmetric-grover-weakened-long-lived-by-name' END,
      CASE WHEN s_short AND x BETWEEN 10 AND 24 THEN 'symmetric-grover-weakened-medium-lived' END,
      CASE WHEN s_named AND x BETWEEN 10 AND 24 THEN 'symmetric-grover-weakened-medium-lived-by-name' END,
      CASE WHEN s_short AND x <= 9 THEN 'symmetric-adequate-for-short-lived-data' END,
      CASE WHEN s_named AND x <= 9 THEN 'symmetric-adequate-for-short-lived-data-by-name' END,
      CASE WHEN s_short AND x IS NULL THEN 'symmetric-grover-weakened-lifetime-unknown' END,
      CASE WHEN s_named AND x IS NULL THEN 'symmetric-grover-weakened-lifetime-unknown-by-name' END,
      CASE WHEN s_legacy THEN 'symmetric-legacy-block-cipher' END, CASE WHEN s_long THEN 'symmetric-adequate-key-size' END],
      lambda v: v IS NOT NULL)), ',') AS fired_rules
  FROM parts
)
"""


VERDICT = scored()
