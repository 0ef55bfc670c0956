import json
import random

import pytest
from pyspark.sql import functions as F
from test_policy import finding

from cipherfolio.operators import correlate, metrics, policy, store
from cipherfolio.operators import inventory as inv
from cipherfolio.schema import FINDING
from cipherfolio.sources import cbom


@pytest.fixture(scope="module")
def parts(spark):
    rows = [finding(), finding(algorithm="AES", primitive="block-cipher", params={"key_size": "128"}), finding(algorithm="MD5", primitive="hash", params={}, usage="hash"),
            finding(view="observed", scanner_id="rt", algorithm="TLS", asset_type="protocol", primitive="unknown", params={"version": "TLSv1.2"},
                    occurrences=[("observed", "host:h:pid9", "p", "nginx via /lib")])]
    found = spark.createDataFrame(rows, FINDING)
    targets = spark.createDataFrame([("s", "app", "Personal", "bfsi", "internet")], "scan_id string, system string, data_class string, sector string, exposure string")
    components, drifts = correlate.correlate(policy.score_components(inv.build_components(found), targets))
    scans = spark.createDataFrame([("s", "repo", "app", "scan", None, "bfsi", "internet", 11, ["source"])],
                                  "scan_id string, ref string, system string, kind string, parent_scan_id string, sector string, exposure string, z_years int, scanners_ran array<string>"
                                  ).withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    return components, drifts, scans, targets, inv.sightings(inv.normalise(found))


def test_save_twice_is_one_snapshot_and_rescore_leaves_the_parent(spark, parts, tmp_path):
    components, drifts, scans, targets, seen = parts
    root = str(tmp_path / "store")
    store.save_scans(components, drifts, scans, root, seen)
    store.save_scans(components, drifts, scans, root, seen)
    before = store.read(spark, root, "components").count()
    assert before == 4
    row = store.read(spark, root, "scans").first()
    assert row.component_count == 4 and sum(row.band_counts.values()) == 4 and row.drift_counts == {}
    store.rescore(spark, root, "s", "s-z30", targets.drop("scan_id"), "2026-02-01", 30)
    store.rescore(spark, root, "s-z30", "s-z5", targets.drop("scan_id"), "2026-03-01", 5)
    rows = {r.scan_id: r for r in store.read(spark, root, "scans").collect()}
    assert rows["s"].max_score == row.max_score
    assert rows["s-z30"].kind == "rescore" and rows["s-z30"].parent_scan_id == "s" == rows["s-z5"].parent_scan_id
    assert rows["s-z30"].scanners_ran == [] and rows["s-z30"].z_years == 30
    assert rows["s-z30"].max_score < rows["s"].max_score <= rows["s-z5"].max_score
    assert store.read(spark, root, "components", ["s"]).count() == before


def test_saving_again_replaces_rows_the_new_save_lacks(spark, parts, tmp_path):
    components, drifts, scans, _, seen = parts
    root = str(tmp_path / "again")
    drift = spark.createDataFrame([("app", "tls", "r1", "kind", "a", "b", 1, 0.5, None, "s")], store.DRIFTS)
    store.save_scans(components, drift, scans, root, seen)
    assert store.read(spark, root, "drifts").count() == 1 and store.read(spark, root, "scans").first().drift_counts == {"kind": 1}
    store.save_scans(components.filter("algorithm = 'AES'"), drifts.limit(0), scans, root, seen.limit(0))
    assert store.read(spark, root, "drifts").count() == 0 and store.read(spark, root, "occurrences").count() == 0
    assert store.read(spark, root, "components").count() == 1 and store.read(spark, root, "scans").first().drift_counts == {}
    assert store.superseded(spark, root, "components").count() == 1


def test_rescore_takes_one_target_of_its_own_scan_and_a_fix_is_a_child(spark, parts, tmp_path):
    components, drifts, scans, targets, _ = parts
    root = str(tmp_path / "targets")
    store.save_scans(components, drifts, scans, root)
    other = targets.withColumn("scan_id", F.lit("elsewhere")).withColumn("exposure", F.lit("internal"))
    store.rescore(spark, root, "s", "s2", targets.unionByName(other).unionByName(targets), "2026-02-01", 30)
    assert store.read(spark, root, "components", ["s2"]).count() == 4
    scored = store.read(spark, root, "components", ["s"])
    store.save_fix(spark, root, "s", "fixed", scored.filter("algorithm <> 'MD5'"), store.read(spark, root, "drifts", ["s"]), "2026-02-02")
    row = store.read(spark, root, "scans", ["fixed"]).first()
    assert (row.kind, row.parent_scan_id, row.component_count) == ("fix", "s", 3)
    rows, _ = store.combined(spark, root, ["s", "fixed"], "both")
    # Nothing is folded: three artefacts are in both scans, each with the verdict of its own.
    found = rows.collect()
    assert len(found) == 7 and len({r.bom_ref for r in found}) == 4 and {r.scan_id for r in found} == {"both"}


def test_exports_can_be_retried(spark, parts, tmp_path):
    components, _, _, _, seen = parts
    for _ in range(2):
        cbom.write_document(components, seen, str(tmp_path / "doc2"))
        store.write_jsonl(components.select("bom_ref", "name"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "doc2") + "/components").count() == 4 == spark.read.json(str(tmp_path / "lines")).count()


def test_document_round_trip(spark, parts, tmp_path):
    components, _, _, _, seen = parts
    path = str(tmp_path / "doc")
    cbom.write_document(components, seen, path)
    lines = spark.read.text(f"{path}/components").withColumnRenamed("value", "json")
    back = {r.bom_ref: r for r in cbom.read_lines(lines).collect()}
    for row in components.collect():
        twin = back[row.bom_ref]
        assert (twin.name, twin.algorithm, twin.score, twin.band, twin.labels, twin.actions, twin.params) == (
            row.name, row.algorithm, row.score, row.band, row.labels, row.actions, row.params)
    refs = [json.loads(r.value)["bom-ref"] for r in spark.read.text(f"{path}/occurrences").collect()]
    assert len(refs) == len(set(refs)) == 4 and all(r.endswith("#0") for r in refs)


def test_whole_documents_are_read(spark, tmp_path):
    def prop(name, value):
        return {"name": cbom.PREFIX + name, "value": value}

    document = {"metadata": {"component": {"name": "app"}}, "components": [{
        "bom-ref": "r1", "name": "RSA-2048", "type": "cryptographic-asset", "cryptoProperties": {"assetType": "algorithm", "algorithmProperties": {"primitive": "pke"}},
        "evidence": {"occurrences": [{"location": "a.py", "line": 3, "additionalContext": "d :: code"}]},
        "properties": [prop("asset_type", "algorithm"), prop("view", "declared"), prop("view", "shipped"), prop("confidence", "1.5"), prop("param:key_size", "2048"),
                       prop("labels", "a, b,"), prop("occurrence", "declared|a.py:3|source|x|y"), prop("drift:kind", "k1"), prop("drift:declared", "d1"), prop("band", "Odd")]}]}
    (tmp_path / "doc.json").write_text(json.dumps(document, indent=1))
    rows = cbom.read_documents(spark, str(tmp_path / "doc.json"))
    row = rows.first()
    assert (row.system, row.algorithm, row.views, row.confidence, row.labels, row.band, row.score) == ("app", "RSA", ["declared", "shipped"], None, ["a", "b"], "Low", 0)
    assert row.drift[0].kind == "k1" and row.drift[0].declared == "d1" and row.drift[0].observed is None
    seen = cbom.document_occurrences(rows).first()
    assert (seen.view, seen.locator, seen.scanner, seen.detail, seen.snippet) == ("declared", "a.py:3", "source", "x|y", "d :: code")


def test_csv_export(spark, parts, tmp_path):
    components = parts[0]
    path = str(tmp_path / "csv")
    store.write_csv(store.inventory_export(components), path)
    back = spark.read.option("header", "true").csv(path)
    assert back.count() == 4 and "bom_ref" in back.columns and back.filter("endpoint IS NULL").count() == 4


def test_numbering_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(100), i) for i in range(3000)]
    out = inv.number_within(spark.createDataFrame(rows, "k string, a int, b int"), ["k"], ["a", "b"], "n").collect()
    groups = {}
    for k, a, b in rows:
        groups.setdefault(k, []).append((a, b))
    want = {(k, a, b): n for k, items in groups.items() for n, (a, b) in enumerate(sorted(items))}
    assert {(r.k, r.a, r.b): r.n for r in out} == want


def test_previous_scan_with_a_hot_scope(spark):
    rng = random.Random(5)
    rows = [(f"s{i:04d}", "r", "hot" if rng.random() < 0.6 else f"q{i % 3}", "scan" if rng.random() < 0.8 else "fix", None, f"2026-01-{rng.randrange(1, 9):02d} {rng.randrange(24):02d}:00:00")
            for i in range(300)]
    scans = spark.createDataFrame(rows, "scan_id string, ref string, system string, kind string, parent_scan_id string, c string").withColumn("created_at", F.col("c").cast("timestamp"))
    got = {r.scan_id: r.base_scan_id for r in metrics.default_comparison(scans).collect()}
    for sid, _, system, _, _, at in rows:
        earlier = [(c, s) for s, _, sy, kind, _, c in rows if sy == system and kind == "scan" and c < at]
        assert got[sid] == (max(earlier)[1] if earlier else None)
