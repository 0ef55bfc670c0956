import pytest
from pyspark.sql import functions as F

from cipherfolio.operators import inventory as inv
from cipherfolio.sources import config_text, files, system

GOOD = {"system": "app", "sector": "bfsi", "exposure": "internet", "data_class": "Personal"}


def config(spark, target):
    rows = files.config_files(spark, target.ref)
    path = F.regexp_replace("path", "^file:", "")
    return config_text.config_findings(rows.select(F.lit("x").alias("scan_id"), F.lit(target.system).alias("system"), path.alias("path"), "text"))


@pytest.mark.parametrize("change", [{"sector": "space"}, {"exposure": "moon"}, {"system": ""}, {"targets": []}, {"targets": [{"kind": "cloud", "ref": "x"}]}])
def test_manifests_are_refused(change):
    with pytest.raises(system.ManifestError):
        system.parse_manifest({**GOOD, "targets": [{"kind": "repo", "ref": "x"}], **change})


def test_targets_become_one_component_set(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "sshd_config").write_text("Ciphers aes256-ctr\n")
    manifest = system.parse_manifest({**GOOD, "targets": [{"kind": "repo", "ref": str(tmp_path / "one")}, {"kind": "directory", "ref": str(tmp_path / "two")}]})
    rows, context = system.scan_system(spark, manifest, {"repo": [config], "directory": [config]}, "scan-1")
    components = inv.build_components(rows).collect()
    assert len(components) == 2 and {c.system for c in components} == {"app"}
    assert any(c.locus.endswith("\u001fsshd_config") for c in components)
    assert context.first().sector == "bfsi"
    with pytest.raises(system.ManifestError):
        system.scan_system(spark, system.parse_manifest({**GOOD, "targets": [{"kind": "repo", "ref": str(tmp_path / "none")}]}), {"repo": [config]}, "s")
    with pytest.raises(TypeError):
        system.check_findings(spark.range(1), "bad")
