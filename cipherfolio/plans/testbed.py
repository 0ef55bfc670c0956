"""Findings, targets and other inventory inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherfolio.schema import FINDING_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key where the reader cannot split a table further: a given table may be one row group.

    A table of as many splits as a shuffle has is left as it is. Only these adapters do so; operators take the splits of
    their input.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts, key)


_ALGORITHMS = (
    "array('RSA','ECDSA','Ed25519','ECDH','AES','ChaCha20-Poly1305','SHA-1','SHA-256','MD5','3DES',"
    "'ML-KEM','X25519MLKEM768','x25519','TLS','OpenSSL','TLS_AES_256_GCM_SHA384')"
)
_PRIMITIVES = (
    "array('pke','signature','signature','key-agreement','block-cipher','stream-cipher','hash','hash','hash',"
    "'block-cipher','kem','kem','key-agreement','unknown','unknown','unknown')"
)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per line item, shaped by its part and supplier."""
    items = dealt(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus"
    ), "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_name")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    joined = items.join(parts, "l_partkey").join(suppliers, "l_suppkey")
    numbered = joined.selectExpr(
        "*",
        "cast(l_partkey % 16 as int) as i",
        "p_size % 4 as ps",
        "cast((l_partkey div 16) % 3 as string) as place",
        # Nothing is observed in nation 24 and nothing shipped in nation 23: those rows are declared.
        """case when (l_suppkey + l_linenumber) % 3 = 2 and s_nationkey = 24 or (l_suppkey + l_linenumber) % 3 = 1 and s_nationkey = 23 then 'declared'
                else element_at(array('declared','shipped','observed'), cast(1 + (l_suppkey + l_linenumber) % 3 as int)) end as view""",
    )
    shaped = numbered.selectExpr(
        "*",
        """case when i = 0 then element_at(array('1024','2048','3072',cast(null as string)), ps + 1)
                when i = 4 then element_at(array('128','192','256',cast(null as string)), ps + 1) end as size_text""",
    ).selectExpr(
        "*",
        f"element_at({_ALGORITHMS}, i + 1) as algorithm",
        f"element_at({_PRIMITIVES}, i + 1) as primitive",
        "case i when 13 then 'protocol' when 14 then 'library' else 'algorithm' end as asset_type",
        """case when i not in (0, 4) then null
                when l_suppkey % 11 = 0 then 'unknown'
                when l_suppkey % 5 = 0 then concat('  ', size_text, ' ')
                else size_text end as key_size""",
        "case when i in (1, 3) then element_at(array('prime256v1','secp256r1','P-256','p256'), ps + 1) end as curve",
        """case i when 13 then element_at(array('TLSv1_2','tlsv1.2','TLSv1.3'), l_linenumber % 3 + 1)
                  when 14 then element_at(array('3.0.2-0ubuntu1','3.5.0','1:3.4.1-r2','v3.5.7'), ps + 1) end as version""",
        """case when (view = 'declared' and l_linenumber % 3 = 1 and l_linenumber <> 7)
                  or (view = 'observed' and l_linenumber = 1)
                then concat('ep', cast(l_suppkey % 4 as string), ':443') end as endpoint""",
        """case when view = 'observed' and s_nationkey % 5 = 3 then null
                when i = 11 then 'X25519MLKEM768' when i = 12 then 'x25519' end as `group`""",
        """case when i = 11 then element_at(array('true','yes',cast(null as string),'false'), ps + 1)
                when i = 12 and ps = 0 then 'false' end as hybrid""",
        "case when i = 14 then element_at(array('false','true','no',cast(null as string)), ps + 1) end as pqc_capable",
        """case when i = 13 and view = 'declared'
                then element_at(array('TLSv1.3','TLSv1.2',cast(null as string)), l_linenumber % 3 + 1) end as min_version""",
        """case when i = 15 and view = 'declared' then element_at(array('TLS_AES_256_GCM_SHA384',
                'TLS_CHACHA20_POLY1305_SHA256, TLS_AES_256_GCM_SHA384','',cast(null as string)), ps + 1) end as cipher_suites""",
        """case when i = 15 and view = 'observed' then element_at(array('TLS_AES_128_GCM_SHA256',
                'TLS_AES_256_GCM_SHA384','TLS_CHACHA20_POLY1305_SHA256',cast(null as string)), ps + 1) end as cipher_suite""",
        """case when i in (11, 12, 13) and view = 'observed'
                then element_at(array('full','partial','none'), l_linenumber % 3 + 1) end as enrichment""",
        "case when l_suppkey % 10 = 3 then 'ssh-server' end as role",
    )
    names = ("key_size", "curve", "version", "endpoint", "group", "hybrid", "pqc_capable",
             "min_version", "cipher_suites", "cipher_suite", "enrichment", "role")
    params = F.map_filter(
        F.create_map(*[part for n in names for part in (F.lit(n), F.col(n))]), lambda _, v: v.isNotNull()
    )
    return shaped.withColumn("params", params).selectExpr(
        "case when l_linestatus = 'O' then 'base' else 'head' end as scan_id",
        "concat('sys', cast(s_nationkey as string)) as system",
        """case view when 'declared' then element_at(array('source','config','deps'), l_linenumber % 3 + 1)
                     when 'shipped' then element_at(array('container','binary'), l_linenumber % 2 + 1)
                     else 'runtime-spool' end as scanner_id""",
        "view", "asset_type", "primitive", "algorithm", "params",
        """case when i <= 3 then element_at(array('sign','key-transport','unknown'), l_linenumber % 3 + 1)
                when i in (4, 5, 9) then 'encrypt' when i in (6, 7, 8) then 'hash'
                when i in (10, 11, 12) then 'key-exchange' else 'unknown' end as usage""",
        "case l_returnflag when 'A' then true when 'R' then false end as configurable",
        """array(named_struct(
             'view', view,
             'locator', case when view = 'observed'
                 then concat('host:h', place, ':pid', cast(l_orderkey % 1000 as string))
                 else concat('svc/f', place, '.py:', cast(l_linenumber as string)) end,
             'detail', concat('rule=r', cast(i as string)),
             'snippet', case when view = 'observed'
                 then concat(element_at(array('nginx','envoy','curl','java'), cast(l_suppkey % 4 as int) + 1), ' via /usr/lib/libssl.so.3')
                 else p_name end)) as occurrences""",
        "1.0D - l_discount as confidence",
    ).select(*FINDING_COLUMNS)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of each (scan, system): one row per nation and scan."""
    return table(spark, sf_dir, "nation").selectExpr(
        "explode(array('base','head')) as scan_id",
        "concat('sys', cast(n_nationkey as string)) as system",
        "element_at(array('Public',' internal ','IP','health','not-listed'), n_nationkey % 5 + 1) as data_class",
        """element_at(array('government','strategic','defence','power','telecom','transport','bfsi','other'),
                      n_nationkey % 8 + 1) as sector""",
        "element_at(array('internet','internal','build','unknown','internet'), n_regionkey + 1) as exposure",
    )


def damaged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings, each also as a copy that breaks one rule chosen by its content."""
    rows = findings(spark, sf_dir)
    kind = "cast(conv(substring(md5(concat(system, algorithm, occurrences[0].locator, scanner_id)), 1, 2), 16, 10) as int) % 5"
    broken = rows.withColumn("kind", F.expr(kind)).selectExpr(
        "scan_id", "system", "scanner_id",
        "case when kind = 0 then 'guessed' else view end as view",
        "case when kind = 4 then 'widget' else asset_type end as asset_type",
        "primitive", "algorithm", "params", "usage", "configurable",
        "case when kind = 2 then slice(occurrences, 1, 0) else occurrences end as occurrences",
        "case when kind = 1 then confidence + 1.5D when kind = 3 then double('NaN') else confidence end as confidence",
    )
    return rows.unionByName(broken.select(*rows.columns))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored scan per order; every fourth is a rescore of the one before."""
    return table(spark, sf_dir, "orders").selectExpr(
        "lpad(cast(o_orderkey as string), 12, '0') as scan_id",
        "concat('repo', cast(o_custkey % 40 as string)) as ref",
        "case when o_custkey % 40 < 30 then concat('sys', cast(o_custkey % 40 as string)) end as system",
        "case when o_orderkey % 4 = 3 then 'rescore' when o_orderkey % 16 = 5 then 'fix' else 'scan' end as kind",
        "case when o_orderkey % 4 = 3 then lpad(cast(o_orderkey - 1 as string), 12, '0') end as parent_scan_id",
        "o_orderdate as created_at",
        "case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then array() else array('source', 'config') end as scanners_ran",
        "cast(o_custkey % 7 as bigint) as critical",
        "cast(o_orderkey % 5 as bigint) as high",
        "cast(o_orderkey % 3 as bigint) as coverage_gaps",
    )


def page_gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as examined files: unbalanced paragraphs are partial, a stray close is unparsed."""
    pages = table(spark, sf_dir, "pages").selectExpr(
        "'base' as scan_id",
        "element_at(array('source', 'config', 'deps'), cast(page_id % 3 as int) + 1) as scanner",
        "url as path",
        "length(html) - length(replace(html, '<p>', '')) as opened",
        "length(html) - length(replace(html, '</p>', '')) as closed",
        "html",
    )
    gaps = pages.filter("opened * 4 <> closed * 3").selectExpr(
        "scan_id", "scanner", "path",
        "case when closed * 3 > opened * 4 then 'unparsed' else 'partially-parsed' end as kind",
        "'unbalanced paragraphs' as reason",
    )
    examined = pages.groupBy("scan_id", "scanner").agg(F.count_distinct("path").alias("examined"))
    return gaps, examined


# Text of configuration files, package databases, manifests and code, built
# from part rows. The expressions mean the same in both SQL dialects.
NGINX_TEXT = """concat_ws(chr(10), concat('# ', p_name, ' ssl_protocols TLSv1;'), 'http {', '  map $host $x {', '    default ssl_ciphers;', '  }', '  server {',
  CASE WHEN p_size % 3 = 0 THEN '    listen [::]:8443;' ELSE '    listen 443 ssl; # tls' END,
  CASE WHEN p_size % 5 <> 0 THEN concat('    server_name host', p_partkey % 50, '.example alt.example;') END,
  CASE WHEN p_size % 4 = 0 THEN '    ssl_protocols TLSv1.1 TLSv1.2;' WHEN p_size % 4 = 1 THEN '    ssl_protocols TLSv1.3;' END,
  '    location / {', '      ssl_ciphers INNER:IGNORED;', '    }',
  CASE WHEN p_size % 2 = 0 THEN '    ssl_ciphers ECDHE-A:ECDHE-B;' END, CASE WHEN p_size % 6 = 0 THEN '    ssl_ciphers LAST-WINS:;' END,
  CASE WHEN p_size % 7 < 3 THEN '    ssl_ecdh_curve X25519MLKEM768:P-256;' WHEN p_size % 7 < 5 THEN '    ssl_ecdh_curve P-384;' END,
  CASE WHEN p_size % 9 = 0 THEN concat('    ssl_certificate /etc/ssl/', p_partkey, '.pem;') END,
  '  }', '  server {', '    listen 80;', '    server_name plain.example;',
  CASE WHEN p_size % 11 = 0 THEN '    ssl_protocols SSLv3;' END, '  }', CASE WHEN p_size % 13 = 0 THEN '}' END, '}')"""
SSHD_TEXT = """concat_ws(chr(10), concat('# Ciphers ', p_name), CASE WHEN p_size % 2 = 0 THEN 'KexAlgorithms mlkem768x25519-sha256' END,
  CASE WHEN p_size % 3 = 0 THEN 'Ciphers aes256-gcm@openssh.com,aes128-ctr   # fast' END, 'Port 22',
  CASE WHEN p_size % 5 < 3 THEN '  ciphers 3des-cbc' END, 'kexalgorithms diffie-hellman-group14-sha1', CASE WHEN p_size % 7 = 0 THEN 'MACs hmac-md5' END)"""
OPENSSL_TEXT = """concat_ws(chr(10), 'Groups = before', '[openssl_init]', 'Groups = elsewhere', '[ System_Default_Sect ] # here',
  CASE WHEN p_size % 2 = 0 THEN 'Groups = X25519MLKEM768:P-256' END, CASE WHEN p_size % 3 = 0 THEN '# MinProtocol = TLSv1' END,
  CASE WHEN p_size % 3 < 2 THEN 'MinProtocol = TLSv1.2' END, CASE WHEN p_size % 5 = 0 THEN 'CipherString = DEFAULT:@SECLEVEL=2' END,
  CASE WHEN p_size % 4 = 0 THEN 'minprotocol = TLSv1.3' END, '[other]', 'MaxProtocol = TLSv1.1')"""
DPKG_TEXT = """concat_ws(chr(10), concat('Package: ', CASE p_size % 4 WHEN 0 THEN 'libssl3' WHEN 1 THEN 'libgnutls30' WHEN 2 THEN 'OpenSSL' ELSE 'bash' END),
  CASE WHEN p_size % 9 = 0 THEN 'Status: deinstall ok config-files' ELSE 'Status: install ok installed' END,
  CASE WHEN p_size % 2 = 0 THEN 'Source: openssl' END, concat('Version: ', CASE p_size % 3 WHEN 0 THEN '1:3.' ELSE '3.' END, p_size % 8, '.', p_partkey % 20, '-0ubuntu1'),
  'Description: text', ' Version: 9.9.9', '', concat('Package: tool', p_partkey % 10), 'Status: install ok installed', 'Version: 1.0', '')"""
APK_TEXT = """concat_ws(chr(10), CASE WHEN p_size % 3 = 0 THEN 'P:libcrypto3' ELSE 'P:musl' END, concat('V:3.', p_size % 8, '.', p_partkey % 10, '-r0'), 'o:openssl', '', 'P:broken', '')"""
REQUIREMENTS_TEXT = """concat_ws(chr(10), '# pinned', CASE WHEN p_size % 2 = 0 THEN concat('cryptography==42.0.', p_partkey % 9) ELSE 'cryptography>=41.0,<43' END, 'requests>=2.31', 'PyJWT==2.8.0  # tokens')"""
POETRY_TEXT = """concat_ws(chr(10), '[[package]]', 'name = "cryptography"', concat('version = "43.0.', p_partkey % 9, '"'), '', '[[package]]', 'name = "click"', 'version = "8.1.7"')"""
GO_MOD_TEXT = """concat_ws(chr(10), 'module example.com/app', 'require (', concat(chr(9), 'golang.org/x/crypto v0.', p_size, '.0 // indirect'), chr(9) || 'github.com/pkg/errors v0.9.1', ')')"""
PACKAGE_JSON_TEXT = """concat('{"dependencies": {"node-forge": "^1.', p_size % 4, '.1", "left-pad": "1.3.0"}, "devDependencies": {"elliptic": "6.5.', p_size % 6, '"}}')"""
CODE_TEXT = """concat_ws(chr(10), concat('# ', p_name),
  CASE p_size % 6 WHEN 0 THEN concat('key = rsa.generate_private_key(public_exponent=65537, key_size=', 1024 * (1 + p_size % 4), ')')
    WHEN 1 THEN 'key = rsa.generate_private_key(public_exponent=65537, key_size=bits)' WHEN 2 THEN 'digest = hashlib.md5(data).hexdigest()'
    WHEN 3 THEN 'c = Cipher(algorithms.AES(k), modes.ECB())' WHEN 4 THEN 'curve = ec.generate_private_key(ec.SECP256R1())' ELSE 'print("nothing here")' END,
  CASE WHEN p_size % 5 = 0 THEN concat('API_KEY = "', md5(concat('k', p_partkey)), '"') END,
  CASE WHEN p_size % 10 = 0 THEN 'cipher = AES.new(API_KEY, AES.MODE_CBC)' END,
  CASE WHEN p_size % 7 = 0 THEN 'k2 = rsa.generate_private_key(key_size=int(os.environ["BITS"])).sign(data)' END)"""


def text_files(spark: SparkSession, sf_dir: str, path: str, text: str) -> DataFrame:
    """One file per part; ``path`` and ``text`` are SQL over part columns."""
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return part.selectExpr("'base' as scan_id", "concat('sys', p_partkey % 25) as system", f"{path} as path", f"{text} as text")


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests and lockfiles, some beside each other and some vendored."""
    folder = "concat('repo/p', p_partkey, '/"
    kinds = (
        (folder + "requirements.txt')", REQUIREMENTS_TEXT, "true"),
        (folder + "poetry.lock')", POETRY_TEXT, "p_size % 3 = 0"),
        (folder + "go.mod')", GO_MOD_TEXT, "p_size % 4 = 0"),
        (folder + "package.json')", PACKAGE_JSON_TEXT, "p_size % 5 < 3"),
        (folder + "node_modules/x/package.json')", PACKAGE_JSON_TEXT, "p_size % 5 = 0"),
    )
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = None
    for path, text, when in kinds:
        one = part.where(when).selectExpr("'base' as scan_id", "concat('sys', p_partkey % 25) as system", f"{path} as path", f"{text} as text")
        rows = one if rows is None else rows.unionByName(one)
    return rows


# Event lines built from event rows: handshakes, accessor reads, damaged lines.
EVENT_LINE = """CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN '{"pid": 12, broken' WHEN 1 THEN '[1, 2]'
    WHEN 2 THEN '{"pid": -5, "comm": "x", "phase": "return"}' WHEN 3 THEN concat('{"pid": 7, "comm": "', repeat('x', 400), '"}')
    ELSE '{"pid": 9, "comm": "x", "phase": "return", "retval": 1, "observed_cipher": 17}' END
  ELSE concat('{"pid": ', 1000 + user_id, ', "tid": ', user_id, ', "comm": "', CASE user_id % 3 WHEN 0 THEN 'nginx' WHEN 1 THEN 'envoy' ELSE 'java' END,
    '", "libssl_path": "/usr/lib/libssl.so.3", "phase": "', CASE WHEN event_type = 'signup' THEN 'return' ELSE 'enrich' END,
    '", "retval": ', CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN '-1' ELSE '1' END, ', "timestamp": ', event_id,
    CASE WHEN event_id % 3 = 0 THEN ', "observed_version": "TLSv1.3"' WHEN event_id % 3 = 1 THEN ', "observed_version": ""' ELSE '' END,
    CASE WHEN event_id % 4 = 0 THEN ', "observed_cipher": "TLS_AES_256_GCM_SHA384"' WHEN event_id % 4 = 1 THEN ', "observed_cipher": "TLS_CHACHA20_POLY1305_SHA256"' ELSE '' END,
    CASE WHEN event_id % 7 = 0 THEN ', "observed_group": "X25519MLKEM768"' WHEN event_id % 7 < 3 THEN ', "observed_group": "x25519"'
         WHEN event_id % 7 = 3 THEN ', "observed_group": null' ELSE '' END, '}') END"""
EVENT_FILE = "concat('spool-', event_id % 50, '.jsonl')"
MAX_EVENT_LINE = 350


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "events").drop("props"), "event_id").selectExpr(f"{EVENT_FILE} as path", "cast(event_id as int) as line_no", f"{EVENT_LINE} as line")


def handshake_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a thread of each user on each of two hosts: signups complete, the rest read values."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('h', event_id % 2) as host", "1000 + user_id as pid", "user_id as tid", "unix_micros(cast(ts as timestamp)) as ts_us",
        "case when event_type = 'signup' then 'return' else 'enrich' end as phase",
        "case when event_type = 'signup' and event_id % 5 = 0 then -1L else 1L end as retval",
        "case when event_id % 3 = 0 then 'TLSv1.3' end as version",
        "case event_type when 'click' then 'TLS_AES_256_GCM_SHA384' when 'purchase' then '' end as cipher",
        "case event_type when 'view' then 'x25519' end as `group`")


OPENSSL_OLD_TEXT = """concat_ws(chr(10), '[system_default_sect]', 'Groups = P-256:X448 # keep', CASE WHEN p_size % 2 = 0 THEN 'MinProtocol = TLSv1' ELSE 'MinProtocol = TLSv1.2' END)"""
MD5_TEXT = """concat_ws(chr(10), '# tool', CASE p_size % 3 WHEN 0 THEN 'def store(password):' WHEN 1 THEN 'def checksum(data):' ELSE 'def run(data):' END,
  CASE WHEN p_size % 5 = 0 THEN concat_ws(chr(10), '    a = 1', '    b = 2', '    c = 3', '    d = 4', '    e = 5', '    f = 6') END, '    h = hashlib.md5(data).hexdigest()', '    return h')"""
