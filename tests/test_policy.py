import datetime as dt

import pytest
from pyspark.sql import functions as F

from cipherfolio import knowledge
from cipherfolio.operators import inventory as inv
from cipherfolio.operators import policy
from cipherfolio.schema import FINDING


def finding(**over):
    row = dict(
        scan_id="s", system="app", scanner_id="source", view="declared", asset_type="algorithm", primitive="pke", algorithm="RSA",
        params={"key_size": "2048"}, usage="unknown", configurable=None, confidence=1.0,
        occurrences=[("declared", "a.py:1", "rule=x", "code")])
    row.update(over)
    return tuple(row[f.name] for f in FINDING.fields)


def score(spark, rows, context, packs=None, z=None):
    findings = spark.createDataFrame(rows, FINDING)
    targets = spark.createDataFrame([("s", "app", *context)], "scan_id string, system string, data_class string, sector string, exposure string")
    return policy.score_components(inv.build_components(findings), targets, packs, z).collect()


def test_known_answers(spark):
    [row] = score(spark, [finding(configurable=False)], ("Personal", "bfsi", "internet"))
    assert (row.score, row.band) == (98, "Critical")
    assert row.categories == {"quantum": 40, "mosca": 28, "criticality": 20, "exposure": 10}
    assert row.deadline == dt.date(2027, 12, 31)
    [row] = score(spark, [finding()], ("Public", "other", "internal"))
    assert (row.score, row.band) == (45, "Medium")


def test_unknown_lifetime_is_not_zero(spark):
    [row] = score(spark, [finding(algorithm="AES", primitive="block-cipher", params={"key_size": "128"})], (None, "other", "unknown"))
    assert row.x_years is None and row.categories["mosca"] == 0 and row.categories["symmetric"] == 12
    assert {"mosca-data-lifetime-unknown", "data-lifetime-unknown"} <= set(row.labels)


def test_horizon_moves_the_score(spark):
    near = score(spark, [finding()], ("Internal", "other", "unknown"), z=5)[0].score
    far = score(spark, [finding()], ("Internal", "other", "unknown"), z=30)[0].score
    assert near > far


def pack(*rules, caps=None):
    base = dict(citation="c", verified=True, source="s")
    return knowledge.make_pack({"pack": "p", "citation": "c", "caps": caps or {}, "rules": [{**base, **r} for r in rules]})


def test_absent_satisfies_nothing_but_absence(spark):
    rules = [
        {"id": "not-in", "when": {"mode": {"not_in": ["ECB"]}}, "effect": {"score": 1, "category": "a"}},
        {"id": "min", "when": {"key_size": {"min": 1}}, "effect": {"score": 1, "category": "a"}},
        {"id": "gone", "when": {"mode": {"present": False}}, "effect": {"score": 1, "category": "a"}},
        {"id": "views", "when": {"views": {"contains": "declared"}}, "effect": {"score": 1, "category": "a"}},
        {"id": "flag", "when": {"hybrid": True}, "effect": {"score": 1, "category": "a"}},
    ]
    [row] = score(spark, [finding(params={"key_size": "unknown", "hybrid": "yes"})], (None, "other", "unknown"), [pack(*rules)])
    assert row.fired_rules == ["flag", "gone", "views"]


def test_unverified_rules_label_but_do_not_score(spark):
    rules = [
        {"id": "u", "when": {"algorithm": "RSA"}, "verified": False,
         "effect": {"score": 30, "category": "a", "label": "l", "action": "do", "deadline": "2026-05-05", "quantum_status": "broken"}},
        {"id": "second", "when": {"quantum_status": "broken"}, "effect": {"score": 9, "category": "b"}},
    ]
    [row] = score(spark, [finding()], (None, "other", "unknown"), [pack(*rules)])
    assert row.score == 0 and row.categories == {"a": 0} and row.fired_rules == ["u"] and row.provisional_rules == ["u"]
    assert row.labels == ["l" + policy.UNVERIFIED_LABEL] and row.actions == [policy.UNVERIFIED_ACTION + "do"]
    assert row.deadline_provisional and row.quantum_status is None


def test_narrowest_cap_and_default_cap(spark):
    one = knowledge.make_pack({"pack": "a", "citation": "c", "caps": {"x": 30}, "rules": [
        {"id": "r1", "when": {"algorithm": "RSA"}, "effect": {"score": 50, "category": "x"}, "citation": "c", "verified": True, "source": "s"}]})
    two = knowledge.make_pack({"pack": "b", "citation": "c", "caps": {"x": 20}, "rules": [
        {"id": "r2", "when": {"algorithm": "RSA"}, "effect": {"score": 99, "category": "y"}, "citation": "c", "verified": True, "source": "s"}]})
    [row] = score(spark, [finding()], (None, "other", "unknown"), [one, two])
    assert row.categories == {"x": 20, "y": 40}


@pytest.mark.parametrize("change", [
    {"citation": ""}, {"when": {}}, {"when": {"a": {"like": 1}}}, {"effect": {"score": 1, "category": "a", "odd": 1}},
    {"effect": {"category": "a"}}, {"effect": {"type": "other", "category": "a"}}, {"effect": {"type": "mosca_urgency", "score": 1, "category": "a"}},
    {"source": ""}, {"effect": {"score": True, "category": "a"}}, {"id": ""},
])
def test_bad_rules_are_refused_at_load(change):
    rule = {"id": "r", "when": {"a": 1}, "effect": {"score": 1, "category": "a"}, "citation": "c", "verified": True, "source": "s", **change}
    with pytest.raises(knowledge.KnowledgeError):
        knowledge.make_pack({"pack": "p", "citation": "c", "rules": [rule]})


def test_rule_ids_are_unique_and_packs_complete():
    packs = knowledge.load_packs()
    assert sum(len(p.rules) for p in packs) == 30 and len(packs) == 5
    with pytest.raises(knowledge.KnowledgeError):
        knowledge.check_packs([packs[0], packs[0]])


def test_folding_rules_and_order_independence(spark):
    rows = [
        finding(configurable=True, confidence=0.4), finding(configurable=None, params={"key_size": " 2048 "}, scanner_id="deps"),
        finding(configurable=False, occurrences=[("declared", "a.py:9", "rule=y", None)]), finding(params={"key_size": "unknown"}),
    ]
    one = inv.build_components(spark.createDataFrame(rows, FINDING)).orderBy("bom_ref").collect()
    two = inv.build_components(spark.createDataFrame(rows[::-1], FINDING).repartition(3)).orderBy("bom_ref").collect()
    assert one == two and len(one) == 2
    merged = next(r for r in one if r.name == "RSA-2048")
    assert merged.configurable is False and merged.confidence == 1.0 and merged.n_findings == 3


def test_validation_reasons(spark):
    rows = [finding(), finding(view="x"), finding(confidence=float("nan")), finding(occurrences=[]), finding(asset_type="y")]
    good, bad = inv.split_valid(spark.createDataFrame(rows, FINDING))
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["asset_type", "confidence", "evidence", "view"]


def test_canonical_params_are_idempotent(spark):
    from cipherfolio.functions import canonical as C

    values = {"key_size": " 0256 ", "mode": "gcm", "curve": "secp384r1", "version": "tlsv1_2", "valid_to": "20300102", "hybrid": "Yes", "other": " x ",
              "flagged": "maybe"}
    df = spark.createDataFrame([(values,)], "p map<string,string>").select(C.canonical_params(F.col("p")).alias("a"))
    row = df.select("a", C.canonical_params(F.col("a")).alias("b")).first()
    assert row.a == row.b == {"key_size": "256", "mode": "GCM", "curve": "P-384", "version": "TLSv1.2", "valid_to": "2030-01-02", "hybrid": "true",
                              "other": " x ", "flagged": "maybe"}
