"""Fix proposals for lines of configuration and code, verified by detection.

A template is data: which findings it speaks to, a guard with a reason, and
the new text of the cited line. A fix is released only when detection on the
patched lines no longer reports the finding and reports no new Critical one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherfolio.functions import canonical as C
from cipherfolio.knowledge import Pack
from cipherfolio.operators import compare, policy
from cipherfolio.operators import inventory as inv
from cipherfolio.operators.durable import durable

# Targets of the rewrites, retired versions and the vote words.
HYBRID_GROUP = "X25519MLKEM768"
NGINX_PROTOCOL = "TLSv1.3"
MINIMUM_PROTOCOL = "TLSv1.2"
RETIRED = ("SSLv2", "SSLv3", "TLSv1", "TLSv1.1")
MD5_CALL, SHA256_CALL = "hashlib.md5(", "hashlib.sha256("
BEFORE, AFTER = 6, 2
PASSWORD_WORDS = (
    "password", "passwd", "pwd", "passphrase", "credential", "login", "secret", "salt", "argon2", "bcrypt", "scrypt", "pbkdf2",
)
INTEGRITY_WORDS = (
    "checksum", "digest", "etag", "fingerprint", "integrity", "content_hash", "cache_key", "manifest", "payload", "artefact", "artifact", "chunk",
)
METHOD_NOISE = r"\.(?:hex)?digest\s*\("


@dataclass(frozen=True)
class Template:
    """``matches``, ``refusal`` and ``rewrite`` read the finding columns, the
    cited ``line`` and its ``context``."""

    id: str
    source: str
    matches: Callable[[], Column]
    refusal: Callable[[], Column]
    rewrite: Callable[[], Column]


def _param(name: str) -> Column:
    return F.try_element_at("params", F.lit(name))


def _nginx(value: str) -> Column:
    """Replace the value of a one-line directive, keeping what surrounds it."""
    return F.when(F.col("line").rlike(r"^\s*\w+\s+[^;]+;"), F.regexp_replace("line", r"^(\s*\w+\s+)[^;]+;", f"$1{value};"))


def _assign(value: Column) -> Column:
    shape = r"^(\s*[A-Za-z_][A-Za-z0-9_]*\s*=\s*)([^#]*?)(\s*(?:#.*)?)$"
    return F.when(F.col("line").rlike(shape), F.concat(F.regexp_extract("line", shape, 1), value, F.regexp_extract("line", shape, 3)))


def _detail(prefix: str) -> Column:
    return (F.col("scanner_id") == "config") & F.startswith(F.col("detail"), F.lit(prefix))


def _openssl_value() -> Column:
    listed = F.filter(F.transform(F.split(F.substring_index(F.substring_index("line", "#", 1), "=", -1), ":"), lambda p: F.trim(p)), lambda p: (p != "") & (p != HYBRID_GROUP))
    return F.when(F.col("primitive") == "key-agreement", F.array_join(F.concat(F.array(F.lit(HYBRID_GROUP)), listed), ":")).otherwise(F.lit(MINIMUM_PROTOCOL))


def _cites(word: str) -> Column:
    return F.when(~F.contains("line", F.lit(word)), F.lit(f"the cited line no longer contains {word}"))


def _md5_refusal() -> Column:
    words = F.lower("context")
    plain = F.regexp_replace(words, METHOD_NOISE, "(")
    return F.coalesce(
        _cites(MD5_CALL),
        F.when(words.rlike("|".join(PASSWORD_WORDS)), F.lit("the context is about a credential; it needs a password hash, not a faster digest")),
        F.when(~plain.rlike("|".join(INTEGRITY_WORDS)), F.lit("the context does not say what the digest is for")))


TEMPLATES: Sequence[Template] = (
    Template(
        "nginx-weak-protocol", "NIST SP 800-52 Rev. 2; RFC 8996; RFC 8446",
        lambda: _detail("nginx") & (F.col("asset_type") == "protocol") & F.arrays_overlap(F.split(_param("versions"), ","), C.literal_words(RETIRED)),
        lambda: _cites("ssl_protocols"), lambda: _nginx(NGINX_PROTOCOL)),
    Template(
        "nginx-add-hybrid-group", "FIPS 203",
        lambda: _detail("nginx") & (F.col("primitive") == "key-agreement") & (_param("hybrid") == "false"),
        lambda: F.coalesce(_cites("ssl_ecdh_curve"), F.when(F.contains("line", F.lit(HYBRID_GROUP)), F.lit("the line already offers the hybrid group"))),
        lambda: _nginx(HYBRID_GROUP)),
    Template(
        "openssl-cnf-groups", "FIPS 203; NIST SP 800-52 Rev. 2",
        lambda: _detail("openssl.cnf") & (((F.col("primitive") == "key-agreement") & (_param("hybrid") == "false")) | ((F.col("asset_type") == "protocol") & _param("min_version").isin(*RETIRED))),
        lambda: F.when(_assign(_openssl_value()) == F.col("line"), F.lit("the line already satisfies this fix")),
        lambda: _assign(_openssl_value())),
    Template(
        "md5-to-sha256", "RFC 6151; FIPS 180-4",
        lambda: (F.col("scanner_id") == "source") & (F.col("algorithm") == "MD5") & (F.col("primitive") == "hash"),
        _md5_refusal, lambda: F.replace("line", F.lit(MD5_CALL), F.lit(SHA256_CALL))),
)


def with_context(lines: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Each line with its neighbours in the file; a file bounds the window."""
    frame = Window.partitionBy("scan_id", "system", "path").orderBy("line_no").rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(frame), "\n"))


def _fingerprint(rows: DataFrame) -> DataFrame:
    """Position-free identity: a moved line is not a new finding."""
    return inv.identify(rows).withColumnRenamed("bom_ref", "fingerprint")


def propose(findings: DataFrame, lines: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One proposal per finding a template speaks to: new line or refusal.

    Only cited lines get a context: lines are joined to the few sites first.
    """
    cited = _fingerprint(findings).withColumn("o", F.get("occurrences", F.lit(0))).withColumn("detail", F.col("o.detail"))
    location, number = C.split_locator(F.col("o.view"), F.col("o.locator"))
    cited = cited.withColumn("path", location).withColumn("line_no", number).filter("line_no IS NOT NULL").drop("o", "occurrences", "entries", "locus")
    chosen, refusal, text, source = F, F, F, F
    for template in templates:
        hit = F.coalesce(template.matches(), F.lit(False))
        chosen = chosen.when(hit, F.lit(template.id))
        source = source.when(hit, F.lit(template.source))
    spoken = cited.withColumn("template", chosen).withColumn("source", source).filter("template IS NOT NULL")
    key = ["scan_id", "system", "path"]
    # Neighbourhoods of the sites only, not of every line of the corpus.
    near = spoken.select(*key, F.explode(F.sequence(F.greatest(F.lit(1), F.col("line_no") - BEFORE), F.col("line_no") + AFTER)).alias("line_no")).distinct()
    shown = with_context(lines.hint("merge").join(near, [*key, "line_no"]))
    located = spoken.join(shown.select(*key, "line_no", "line", "context").hint("merge"), [*key, "line_no"], "left")
    for template in templates:
        mine = F.col("template") == template.id
        refusal = refusal.when(mine, template.refusal())
        text = text.when(mine, template.rewrite())
    proposed = located.withColumn("refusal", F.when(F.col("line").isNull(), F.lit("the cited line does not exist")).otherwise(refusal))
    proposed = proposed.withColumn("new_line", F.when(F.col("refusal").isNull(), text))
    empty = F.col("refusal").isNull() & (F.col("new_line").isNull() | (F.col("new_line") == F.col("line")))
    final = F.when(empty, F.lit("there is nothing to change at this line")).otherwise(F.col("refusal"))
    # Patching and verifying both read the proposals.
    return durable(proposed.withColumn("refusal", final).drop("context"))


FILE = ["scan_id", "system", "path"]


def coloured(proposals: DataFrame, alone: bool = False) -> DataFrame:
    """Proposals with ``colour``: those of one file and colour share a patched copy.

    Lines of one colour lie further apart than a context reaches, and proposals
    for one line differ in colour, so no line belongs to the contexts of two.
    ``alone`` gives every proposal a colour of its own. Proposals without a new
    line have no colour.
    """
    rank = F.row_number().over(Window.partitionBy(*FILE, "line_no").orderBy("fingerprint", "template", "new_line"))
    apart = F.col("line_no") if alone else F.pmod(F.col("line_no"), F.lit(BEFORE + AFTER + 1))
    changing = proposals.filter("new_line IS NOT NULL").withColumn("colour", F.concat_ws(".", apart.cast("string"), rank.cast("string")))
    return changing.unionByName(proposals.filter("new_line IS NULL").withColumn("colour", F.lit(None).cast("string")))


def patch_files(files: DataFrame, proposals: DataFrame) -> DataFrame:
    """One patched copy of a file per colour of its proposals."""
    edit = F.struct("line_no", "new_line")
    edits = proposals.filter("colour IS NOT NULL").groupBy(*FILE, "colour").agg(F.map_from_entries(F.collect_list(edit)).alias("edits"))
    # Sizes of built texts are guessed far too low: neither side may be sent whole through the driver.
    joined = files.hint("merge").join(edits, FILE)
    parts = F.split("text", "\n")
    text = F.array_join(F.transform(parts, lambda line, i: F.coalesce(F.try_element_at("edits", (i + 1).cast("bigint")), line)), "\n")
    # The copy is told apart by its scan, so every detector runs on it unchanged.
    copy = F.concat_ws("\u001f", "scan_id", "colour")
    return joined.select(copy.alias("scan_id"), "system", "path", text.alias("text"))


def _placed(findings: DataFrame) -> DataFrame:
    """Findings with their fingerprint and the file and line they cite first."""
    seen = F.get("occurrences", F.lit(0))
    location, number = C.split_locator(seen["view"], seen["locator"])
    return _fingerprint(findings).withColumn("path", location).withColumn("at", number)


def _judge(proposals: DataFrame, before: DataFrame, files: DataFrame, detector: Callable[[DataFrame], DataFrame],
           critical: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Coloured proposals with ``_still``, ``new_findings``, ``new_criticals`` and ``_beyond``.

    What a copy shows in the context of a site belongs to that site, what it
    shows outside all contexts to each of its sites. In the contexts of other
    sites the untouched file is asked instead. ``_beyond`` says that the copy
    shows something new outside all contexts, so one of several sites did it.
    """
    group = [*FILE, "colour"]
    sites = proposals.filter("colour IS NOT NULL").select(*group, F.col("line_no").alias("site"))
    near = sites.select(*group, "site", F.explode(F.sequence(F.col("site") - BEFORE, F.col("site") + AFTER)).alias("at"))
    copy = F.split("scan_id", "\u001f")
    found = _placed(detector(patch_files(files, proposals))).withColumn("colour", F.get(copy, F.lit(1))).withColumn("scan_id", F.get(copy, F.lit(0)))
    after = durable(found.join(near, [*group, "at"], "left"))
    known = durable(_placed(before).select(*FILE, "at", "fingerprint").distinct())
    shown = after.groupBy(*group, "fingerprint", "site").agg(F.lit(True).alias("_shown"))
    own = shown.filter("site IS NOT NULL").withColumnRenamed("_shown", "_own")
    outside = shown.filter("site IS NULL").drop("site").withColumnRenamed("_shown", "_outside")
    untouched = known.join(near, [*FILE, "at"]).select(*group, "fingerprint", "site").distinct()
    every = untouched.groupBy(*group, "fingerprint").agg(F.count(F.lit(1)).alias("_every"))
    here = untouched.withColumn("_here", F.lit(1))

    arrived = compare.arrivals(known, after, ["scan_id", "fingerprint"])
    # Each arrival counts for its site, those outside all contexts for every site of the copy.
    def counted(rows: DataFrame, name: str) -> DataFrame:
        flat = rows.select(*group, "site", "fingerprint")
        spread = flat.filter("site IS NULL").drop("site").join(sites, group).select(*group, "site", "fingerprint")
        return flat.filter("site IS NOT NULL").unionByName(spread).groupBy(*group, "site").agg(F.count_distinct("fingerprint").alias(name))

    beyond = arrived.filter("site IS NULL").select(*group).distinct().join(sites.groupBy(*group).agg(F.count(F.lit(1)).alias("_sites")).filter("_sites > 1"), group)
    keyed = proposals.withColumn("site", F.col("line_no"))
    joined = (
        keyed.join(own, [*group, "fingerprint", "site"], "left").join(outside, [*group, "fingerprint"], "left")
        .join(every, [*group, "fingerprint"], "left").join(here, [*group, "fingerprint", "site"], "left")
        .join(counted(arrived, "new_findings"), [*group, "site"], "left").join(beyond.select(*group, F.lit(True).alias("_beyond")), group, "left")
    )
    if critical is None:
        joined = joined.withColumn("new_criticals", F.lit(0).cast("bigint"))
    else:
        joined = joined.join(counted(critical(arrived), "new_criticals"), [*group, "site"], "left")
    elsewhere = F.coalesce("_every", F.lit(0)) > F.coalesce("_here", F.lit(0))
    still = F.coalesce("_own", F.lit(False)) | F.coalesce("_outside", F.lit(False)) | elsewhere
    return joined.withColumn("_still", still).withColumn("_beyond", F.coalesce("_beyond", F.lit(False))).drop("_own", "_outside", "_every", "_here", "site")


def verify(proposals: DataFrame, before: DataFrame, files: DataFrame, detector: Callable[[DataFrame], DataFrame],
           critical: Callable[[DataFrame], DataFrame] | None = None, alone: bool = False) -> DataFrame:
    """Proposals with ``verified`` and ``reason``, as if each had been applied by itself.

    ``before`` are the findings on the untouched files. ``critical`` maps
    findings to the subset that counts as Critical; new ones block the fix.
    Detection reads a file once per colour, not once per proposal; only where a
    shared copy shows something new outside all contexts are its proposals
    tried alone. ``alone`` tries all of them alone.
    """
    judged = _judge(durable(coloured(proposals, alone)), before, files, detector, critical)
    if not alone:
        judged = durable(judged)
        unclear = judged.filter("_beyond").select(*proposals.columns)
        if not unclear.isEmpty():
            apart = _judge(durable(coloured(unclear, True)), before, files, detector, critical)
            judged = judged.filter(~F.col("_beyond")).unionByName(apart)
    reason = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal"))
        .when(F.col("_still"), F.lit("the finding is still present after the change"))
        .when(F.coalesce("new_criticals", F.lit(0)) > 0, F.lit("the change introduces a Critical finding"))
    )
    return (
        judged.withColumn("verified", reason.isNull())
        .withColumn("reason", F.coalesce(reason, F.lit("verified: the finding is gone and nothing Critical appeared")))
        .withColumn("new_line", F.when(F.col("verified"), F.col("new_line")))
        .withColumn("new_findings", F.coalesce("new_findings", F.lit(0)))
        .drop("_still", "_beyond", "colour", "refusal", "new_criticals")
    )


def critical_by(targets: DataFrame, packs: Sequence[Pack] | None = None) -> Callable[[DataFrame], DataFrame]:
    """The ``critical`` of ``verify``: findings whose verdict is Critical."""
    def pick(findings: DataFrame) -> DataFrame:
        rows = findings.withColumn("params", F.map_from_entries("entries")).withColumn("views", F.array("view"))
        named = rows.withColumn("name", inv.component_name(F.col("asset_type"), F.col("algorithm"), F.col("params")))
        return policy.score_components(inv.with_structure(named), targets, packs).filter("band = 'Critical'")

    return pick


def preferred(verified: DataFrame) -> DataFrame:
    """One fix per component: verified first, then template, then text."""
    order = Window.partitionBy("scan_id", "fingerprint").orderBy(F.col("verified").desc(), "template", F.coalesce("new_line", F.lit("")), "path", "line_no")
    return verified.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


# --- dependency floors ------------------------------------------------------

def dependency_floor(dependencies: DataFrame, facts: DataFrame) -> DataFrame:
    """Whether a declared dependency permits a release below a confirmed floor."""
    from cipherfolio.sources import packages as P

    rows = P.join_libraries(dependencies, facts)
    bound = F.when(F.col("version_is_range"), P.lower_bound(F.col("version"))).otherwise(F.col("version"))
    known = F.col("floor").isNotNull() & F.col("verified")
    refusal = (
        F.when(~known, F.lit("no confirmed post-quantum release of this library"))
        .when(bound.isNull(), F.lit("the version names no lower bound"))
        .when(P.version_array(bound) >= P.version_array(F.col("floor")), F.lit("already at or above the confirmed release"))
    )
    return rows.withColumn("bound", bound).withColumn("refusal", refusal).withColumn("bump_to", F.when(refusal.isNull(), F.col("floor")))


# --- diffs ------------------------------------------------------------------

def diff_stats(diff: Column) -> Column:
    """Files, added and removed lines of a unified diff."""
    lines = F.split(diff, "\n")
    files = F.size(F.filter(lines, lambda x: x.startswith("+++ ")))
    added = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++ ")))
    removed = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("--- ")))
    return F.struct(files.alias("files"), added.alias("added"), removed.alias("removed"))


def fips_tag(source: Column) -> Column:
    number = F.regexp_extract(source, r"FIPS[\s-]?(\d{2,3}(?:-\d+)?)", 1)
    return F.when(number != "", F.concat(F.lit("FIPS "), number))
