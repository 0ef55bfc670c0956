import pytest

from cipherfolio.operators import correlate
from cipherfolio.operators import inventory as inv
from cipherfolio.schema import FINDING

HYBRID = dict(view="declared", algorithm="X25519MLKEM768", primitive="kem", params={"group": "X25519MLKEM768", "hybrid": "true", "endpoint": "e1:443"})


def row(view, algorithm, params, primitive="unknown", asset_type="algorithm", system="app", place="x"):
    return dict(scan_id="s", system=system, scanner_id="t", view=view, asset_type=asset_type, primitive=primitive, algorithm=algorithm, params=params,
                usage="unknown", configurable=None, confidence=1.0, occurrences=[(view, f"{place}:1", "d", "nginx via /lib/libssl.so")])


def library(capable, version="3.0.2"):
    params = {"version": version} if capable is None else {"version": version, "pqc_capable": capable}
    return row("shipped", "OpenSSL", params, asset_type="library")


def observed(params, algorithm="x25519"):
    return row("observed", algorithm, params, "key-agreement")


DECLARED = row("declared", "X25519MLKEM768", {"group": "X25519MLKEM768", "hybrid": "true", "endpoint": "e1:443"}, "kem")


def run(spark, rows):
    order = [f.name for f in FINDING.fields]
    data = [tuple(r[n] for n in order) for r in rows]
    components = inv.build_components(spark.createDataFrame(data, FINDING))
    members = correlate.members(components)
    return members, [(d.kind, d.observed, d.records, d.confidence) for d in correlate.drifts_of(members).collect()]


@pytest.mark.parametrize("others,expected", [
    ([library("false")], [("shipped-cannot-do-declared", "OpenSSL 3.0.2 (not PQC-capable)", 1, 1.0)]),
    ([library(None)], []),
    ([library("true")], []),
    ([observed({"group": "x25519"})], [("declared-pqc-observed-classical", "x25519", 1, 1.0)]),
    ([observed({"enrichment": "partial"}, "TLS")], [("declared-pqc-observed-unconfirmed", correlate.NOT_READ, 1, 0.5)]),
    ([observed({"enrichment": "full"}, "TLS")], []),
    ([observed({"group": "X25519MLKEM768"})], []),
    ([], []),
])
def test_hybrid_declaration(spark, others, expected):
    assert run(spark, [DECLARED, *others])[1] == expected


def test_downgrade_and_cipher(spark):
    declared = row("declared", "TLS", {"min_version": "TLSv1.3", "cipher_suites": "a, b"}, asset_type="protocol")
    seen = row("observed", "TLS", {"version": "TLSv1.2"}, asset_type="protocol")
    odd = row("observed", "TLS", {"version": "QUICv9"}, asset_type="protocol", place="y")
    suite = row("observed", "c", {"cipher_suite": "c"})
    kinds = sorted(run(spark, [declared, seen, odd, suite])[1])
    assert kinds == [("cipher-outside-declared-set", "c", 1, 1.0), ("protocol-downgrade", "TLSv1.2", 1, 1.0)]


def test_wildcard_joins_every_endpoint(spark):
    plain = row("declared", "x25519", {"group": "x25519", "hybrid": "false", "endpoint": "e2:443"}, "key-agreement")
    members, drifts = run(spark, [DECLARED, plain, observed({"group": "x25519"})])
    assert drifts == [("declared-pqc-observed-classical", "x25519", 1, 1.0)]
    groups = {g.endpoint: (g.n_declared, g.n_observed) for g in correlate.group_views(members).collect()}
    assert groups == {"e1:443": (1, 1), "e2:443": (1, 1)}


def test_explicit_flag_beats_the_name(spark):
    liar = row("declared", "X25519MLKEM768", {"hybrid": "false", "endpoint": "e1:443"}, "kem")
    assert run(spark, [liar, library("false"), observed({"group": "x25519"})])[1] == []


def test_missing_views_are_coverage_not_drift(spark):
    members, drifts = run(spark, [DECLARED])
    [cover] = correlate.coverage(members).collect()
    assert drifts == [] and cover.coverage_views == ["declared"] and cover.coverage_missing == ["observed", "shipped"]


def test_other_systems_never_meet(spark):
    far = {**observed({"group": "x25519"}), "system": "other"}
    assert run(spark, [DECLARED, far])[1] == []


def brute_force(rows):
    """All pairs per group, the way the definition reads."""
    from collections import Counter

    def role(r):
        return (r["params"].get("role") or "tls").removesuffix("-server").removesuffix("-client") or "tls"

    def place(r):
        return r["params"].get("endpoint") or "*"

    out = Counter()
    ends = sorted({place(r) for r in rows if place(r) != "*"}) or ["*"]
    for the_role in {role(r) for r in rows}:
        for end in ends:
            group = [r for r in rows if role(r) == the_role and place(r) in (end, "*")]
            for d in (r for r in group if r["view"] == "declared"):
                for o in (r for r in group if r["view"] == "observed"):
                    suites = {s.strip() for s in d["params"].get("cipher_suites", "").split(",") if s.strip()}
                    if suites and o["params"].get("cipher_suite") and o["params"]["cipher_suite"] not in suites:
                        out[(d["algorithm"], o["params"]["cipher_suite"])] += 1
    return out


def test_skewed_groups_match_brute_force(spark):
    import random

    rng = random.Random(7)
    rows = []
    for i in range(160):
        view = rng.choice(["declared", "observed"])
        params = {}
        if rng.random() < 0.6:
            params["endpoint"] = f"e{rng.choice([0, 0, 0, 1, 2])}"
        if rng.random() < 0.3:
            params["role"] = rng.choice(["ssh-server", "tls-client"])
        if view == "declared":
            params["cipher_suites"] = ",".join(rng.sample("abcde", 2))
        else:
            params["cipher_suite"] = rng.choice("abcdef")
        rows.append(row(view, f"alg{i}", params))
    order = [f.name for f in FINDING.fields]
    components = inv.build_components(spark.createDataFrame([tuple(r[n] for n in order) for r in rows], FINDING))
    found = correlate.drifts_of(correlate.members(components)).join(components.select("bom_ref", "algorithm"), "bom_ref")
    got = {(d.algorithm, d.observed): d.records for d in found.groupBy("algorithm", "observed").sum("records").withColumnRenamed("sum(records)", "records").collect()}
    assert got == dict(brute_force(rows))


def test_drift_effect_starts_from_the_base_score(spark):
    from pyspark.sql import functions as F

    scores = spark.createDataFrame([(4,), (98,), (60,)], "s int").select(correlate.raised_score(F.col("s")).alias("r")).collect()
    assert [r.r for r in scores] == [60, 100, 75]
