"""Steps that many queries share cost what their input costs."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F
from test_policy import finding

from cipherfolio.functions import redact
from cipherfolio.operators import compare
from cipherfolio.operators import inventory as inv
from cipherfolio.plans import event_queries, inventory_queries, testbed
from cipherfolio.schema import FINDING
from cipherfolio.sources import bytescan


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def some_findings(spark):
    rows = [finding(), finding(scanner_id="other"), finding(algorithm="AES", primitive="block-cipher", params={"key_size": "128"})]
    return spark.createDataFrame(rows, FINDING)


def test_sightings_work_out_occurrences_once(spark):
    seen = inv.sightings(inv.identify(some_findings(spark)))
    assert "size(occurrences" not in plan_of(seen)
    assert seen.count() > 0


def test_contributors_are_the_scanners_of_the_sightings(spark):
    found = inv.normalise(some_findings(spark))
    pairs = [rows.select(*inv.COMPONENT_KEY, F.explode("scanners").alias("scanner")).distinct().collect() for rows in (inv.contributors(found), inv.sightings(found))]
    assert sorted(pairs[0]) == sorted(pairs[1]) and len(pairs[0]) == 3


def test_emitted_drift_is_worked_out_once(spark):
    assert "lineitem" not in plan_of(event_queries._emitted_drift(spark, "/root/testdata/sf0.001"))
    assert "LogicalRDD" in plan_of(event_queries._emitted_drift(spark, "/root/testdata/sf0.001"))


def test_entropy_of_texts_of_few_and_of_many_characters(spark):
    draw = random.Random(5)
    many = "".join(chr(0x4E00 + draw.randrange(3 * redact.FEW_CHARACTERS)) for _ in range(2000))
    texts = ["", "a", "aaaa", "abab", "é😀aé", "a\\b.*$1", many, "".join(draw.choice("abcdef é😀") for _ in range(500))]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", redact.entropy(F.col("text")).alias("bits")).collect()
    for n, bits in rows:
        total = len(texts[n])
        want = -sum(k / total * math.log2(k / total) for k in Counter(texts[n]).values())
        assert abs(bits - want) < 1e-9, (n, bits, want)


def test_findings_are_worked_out_once_for_their_validation(spark):
    made = some_findings(spark).withColumn("algorithm", F.md5("algorithm"))
    accepted, rejected = inv.split_valid(made)
    assert plan_of(accepted).count("md5(") == 1
    assert accepted.columns == made.columns and accepted.count() == 3 and rejected.count() == 0


def test_line_items_are_dealt_by_the_key_of_their_first_join(spark):
    dealt = [line for line in plan_of(testbed.findings(spark, "/root/testdata/sf0.001")).splitlines() if "RepartitionByExpression" in line]
    assert not any("l_orderkey" in line.split("],")[0] for line in dealt)


def test_a_text_of_any_place_is_cleaned_among_harmless_ones(spark):
    key = "302e020100300506032b657004220420" + "5a" * 32
    rows = [finding(), finding(params={"note": key}), finding(params=None)]
    for name in ("locator", "detail", "snippet"):
        place = {"view": "declared", "locator": "a.py:1", "detail": "rule=x", "snippet": "a = 1"}
        rows.append(finding(occurrences=[{**place, name: f"see {key} there"}, {**place, "snippet": None}]))
    frame = spark.createDataFrame(rows, FINDING)
    cleaned = redact.redact_findings(frame)
    assert cleaned.columns == frame.columns
    assert [key in str(row) for row in frame.collect()] == [False, True, False, True, True, True]
    assert not any(key in str(row) for row in cleaned.collect())
    assert [r.occurrences for r in cleaned.collect()][:3] == [r.occurrences for r in frame.collect()][:3]
    assert "_line" in plan_of(cleaned)


def test_settled_findings_are_read_by_column(spark):
    rows = inventory_queries.settled(spark, "/root/testdata/sf0.001")
    read = re.findall("ReadSchema: (.*)", inv.sightings(rows)._jdf.queryExecution().sparkPlan().toString())
    assert read and not any("entries" in schema for schema in read)
    assert sorted(inv.fold_components(rows).columns) == sorted(inv.fold_components(inv.normalise(testbed.findings(spark, "/root/testdata/sf0.001"))).columns)


def test_changes_of_two_scans_read_the_sightings_once(spark):
    spots = [("base", "a", ["x"]), ("head", "a", ["x"]), ("base", "b", ["x"]), ("head", "b", ["x", "y"]), ("head", "c", ["x"]), ("other", "d", ["x"])]
    seen = spark.createDataFrame([(s, "sys", "r", "declared", at, "d", by) for s, at, by in spots],
                                 "scan_id string, system string, bom_ref string, view string, locator string, detail string, scanners array<string>")
    once = compare.evidence_changes_of(seen, "base", "head")
    both = compare.evidence_changes(seen.filter("scan_id = 'base'"), seen.filter("scan_id = 'head'"))
    got = sorted((r.locator, r.scanners, r.change) for r in once.collect())
    assert got == [("b", "x", "removed"), ("b", "x,y", "added"), ("c", "x", "added")]
    assert got == sorted((r.locator, r.scanners, r.change) for r in both.collect())
    assert plan_of(once).count("LogicalRDD") + plan_of(once).count("LocalRelation") == 1


def test_imports_are_not_shuffled_to_meet_the_dictionary(spark):
    entries = [{"symbol": s, "library": "l", "algorithm": a, "primitive": "unknown", "usage": "unknown"} for s, a in (("f", "A"), ("g", "B"), ("f", "A"))]
    imports = spark.createDataFrame([("s", "y", "p", w + "@@V_1") for w in ("f", "f", "g", "h")], "scan_id string, system string, path string, symbol string")
    hits = bytescan.symbol_hits(imports, bytescan.symbols(spark, entries))
    plan = hits._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert sorted((r.symbol, r.algorithm) for r in hits.collect()) == [("f", "A"), ("g", "B")]
