"""Fixes tried together in coloured copies are judged as if each had been tried alone."""

import pytest
from pyspark.sql import functions as F

from cipherfolio.operators import remediate
from cipherfolio.operators.durable import durable
from cipherfolio.sources import config_text, detect, files

MD5 = "    checksum = hashlib.md5(data).hexdigest()"


def one_file(*gaps):
    """A file of digests, each so many quiet lines after the one before."""
    lines = ["def checksum(data):"]
    for gap in gaps:
        lines += ["    pass"] * gap + [MD5]
    return "\n".join(lines)


@pytest.fixture
def sources(spark):
    texts = {
        "one.py": one_file(0), "touching.py": one_file(0, 0, 1, 7, 8, 9, 30), "far.py": one_file(20, 20, 20),
        "secret.py": one_file(0).replace("checksum", "store_password"), "none.py": "def run():\n    return 1", "empty.py": "",
    }
    return spark.createDataFrame([("base", f"sys{i % 2}", path, text) for i, (path, text) in enumerate(texts.items())], "scan_id string, system string, path string, text string")


def judged(rows, detector, alone):
    found = durable(detector(rows))
    proposals = remediate.propose(found, files.lines(rows))
    result = remediate.verify(proposals, found, rows, detector, alone=alone)
    columns = ("system", "path", "line_no", "template", "verified", "reason", "new_line", "new_findings")
    return sorted(map(tuple, result.select(*columns).collect()), key=str)


def test_together_equals_alone(sources):
    together, alone = judged(sources, detect.source_findings, False), judged(sources, detect.source_findings, True)
    assert together == alone
    verdicts = {(r[1], r[4]) for r in together}
    assert {("one.py", True), ("secret.py", False)} <= verdicts
    # The same finding elsewhere in a file outlives a fix of one place, whichever places share a copy.
    assert {r[4] for r in together if r[1] in ("touching.py", "far.py")} == {False}


def test_configuration_together_equals_alone(spark):
    """Findings that differ are mended in shared copies: two blocks, lines that touch, lines a colour apart."""
    def block(protocols, curve, quiet):
        return ["server {", f"    ssl_protocols {protocols};", *["    # quiet"] * quiet, f"    ssl_ecdh_curve {curve};", "}"]

    text = "\n".join([*block("TLSv1 TLSv1.2", "X25519", 0), *["# between"] * 4, *block("SSLv3 TLSv1.2", "secp384r1", 17), *block("TLSv1.1", "prime256v1", 3)])
    rows = spark.createDataFrame([("base", "s", "conf/nginx.conf", text)], "scan_id string, system string, path string, text string")
    together = judged(rows, config_text.config_findings, False)
    assert together == judged(rows, config_text.config_findings, True)
    assert sum(r[4] for r in together) >= 3


def test_new_findings_out_of_reach_are_tried_alone(spark):
    """A detector that sees the whole file reports its first line where two digests or more were replaced."""
    rows = spark.createDataFrame([("base", "s", "far.py", one_file(20, 17, 17))], "scan_id string, system string, path string, text string")
    reports = []

    def whole_file(texts):
        own = detect.source_findings(texts)
        many = texts.filter(F.regexp_count("text", F.lit("sha256")) > 1).select("scan_id", "system")
        first = F.transform("occurrences", lambda o: o.withField("locator", F.concat(F.lit("far.py:1"))))
        extra = own.join(many, ["scan_id", "system"], "left_semi").withColumn("algorithm", F.lit("DES")).withColumn("occurrences", first).select(*own.columns)
        reports.append(extra.count())
        return own.unionByName(extra)

    together = judged(rows, whole_file, False)
    assert max(reports) > 0  # a shared copy did report it
    assert together == judged(rows, whole_file, True)


def test_colours_keep_contexts_apart(sources):
    found = durable(detect.source_findings(sources))
    rows = remediate.coloured(remediate.propose(found, files.lines(sources))).filter("colour IS NOT NULL").collect()
    reach = remediate.BEFORE + remediate.AFTER
    for a in rows:
        for b in rows:
            if a is not b and (a.path, a.colour) == (b.path, b.colour):
                assert abs(a.line_no - b.line_no) > reach
    # Copies are bounded by the reach, not by the proposals.
    assert len({(r.path, r.colour) for r in rows if r.path == "touching.py"}) <= min(reach + 1, 7)


def test_files_are_not_sent_through_the_driver(sources):
    proposals = remediate.coloured(remediate.propose(durable(detect.source_findings(sources)), files.lines(sources)))
    plan = remediate.patch_files(sources, durable(proposals))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
