import json

import pytest
from pyspark.sql import functions as F

from talus.functions.paths import report_uri
from talus.operators import attestation, graph, preinstall, report

ANSWER = "package string, status int, downloads long, owners int, retired boolean, description string, days int, previous_version string, latest_version string"


def test_assessments_in_their_order(spark):
    answers = spark.createDataFrame(
        [
            ("good", 200, 5000, 2, False, "d", 40, "1", "2"), ("bad", 200, 10, 1, True, "", 3, "1", "2"), ("jasno", 404, None, None, None, None, None, None, None), ("gone", 404, None, None, None, None, None, None, None),
            ("jsonx", 200, None, 3, None, "d", None, None, "1"),
        ],
        ANSWER,
    )
    corpus = spark.createDataFrame([("jason", 2), ("json", 1), ("good", 3)], "name string, place int")
    steps = spark.createDataFrame([("bad", "unexpected_new_files"), ("jsonx", "s"), ("down", "s")], "package string, signal string")
    packages = spark.createDataFrame([(p,) for p in ("good", "bad", "jasno", "gone", "jsonx", "down", "bad")], "package string")
    got = {r.package: r for r in preinstall.assessed(packages, answers, corpus, steps).collect()}
    assert {p: r.assessment for p, r in got.items()} == {
        "good": "No concerns identified.",
        "bad": "Warnings: Latest version published 3 days ago; Suspicious version transition; No package description; Package is retired; Single package owner; Low download count (10)",
        "jasno": "CRITICAL: Package does not exist on hex.pm. Also similar to known packages: similar to jason (swap). Likely slopsquatting target.",
        "gone": "CRITICAL: Package does not exist on hex.pm. Verify the package name is correct before installing.",
        "jsonx": "Warnings: Possible typosquat",
        "down": "No concerns identified.",
    }
    assert got["bad"].transitions == ["Version 1 → 2: unexpected_new_files"] and got["jsonx"].transitions == []
    reports = preinstall.assessed(packages, answers, corpus, steps)
    assert {r.package for r in preinstall.warned(reports).collect()} == {"bad", "jasno", "gone", "jsonx"}
    assert preinstall.stops(reports).first().critical and not preinstall.stops(reports.where("not phantom")).first().critical and not preinstall.stops(reports.limit(0)).first().critical


@pytest.mark.parametrize("policy,want", [("advisory", []), ("require", ["warning"]), ("strict", ["critical"])])
def test_trust_by_policy_and_key(spark, policy, want):
    installs = spark.createDataFrame([(p, "1") for p in ("signed", "bare", "wrong", "other")] + [("none", None)], "package string, version string")
    hashes = [("M", "h"), ("N", "h"), ("O", "h")]
    declared = spark.createDataFrame([(p, "1", hashes) for p in ("signed", "wrong", "other")], "package string, version string, module_hashes array<struct<module:string,content_hash:string>>")
    verdicts = spark.createDataFrame([("signed", "1", "k", True), ("signed", "1", "z", False), ("wrong", "1", "k", False), ("other", "1", "unknown", True)], "package string, version string, key string, valid boolean")
    keys = attestation.trusted_keys(spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([("k",), ("a",)], "key string"))
    local = spark.createDataFrame([("signed", "M", "h"), ("signed", "N", "x"), ("signed", "P", "h")], "package string, module string, digest string")
    got = [tuple(r) for r in attestation.findings(installs, declared, verdicts, keys, local, policy).collect()]
    assert sorted(x[3] for x in got if x[2] == "attestation_unsigned") == want
    assert sorted((x[0], x[4], x[5]) for x in got if x[2] != "attestation_unsigned" and x[4]) == [("signed", "N", "mismatch"), ("signed", "O", "missing")]
    assert sorted(x[0] for x in got if x[2] == "attestation_untrusted") == ["other", "wrong"]


def test_report_places_fixes_notes_and_summary(spark):
    paths = spark.createDataFrame([(p,) for p in ("version_diff", "temporal_reputation", "mix.exs", "/x/deps/a/b.ex", "/x/deps/a/deps/b.ex")], "p string")
    assert [r[0] for r in paths.select(report_uri(F.col("p"))).collect()] == ["mix.lock", "mix.lock", "mix.exs", "deps/a/b.ex", "deps/a/deps/b.ex"]
    found = spark.createDataFrame([("a", "x.ex", 1, "k", "critical", "D", "metadata"), ("a", "x.ex", 2, "k", "info", "E", "code_eval"), ("b", "y.ex", 1, "k", "info", "F", "metadata")], "dep string, path string, line int, check_id string, severity string, description string, category string")
    patch = "dep string, action string, target string, version string, verified boolean, diff string, rationale string, category string"
    patches = spark.createDataFrame([("a", "rename_package", "c", None, True, "d", "R", "other"), ("a", "pin_version", None, "1", None, "d", "P", "code_eval"), ("c", "remove_dependency", None, None, None, "d", "X", "")], patch)
    docs = {r.dep: json.loads(r.document)["runs"][0]["results"] for r in report.sarif(found, patches).collect()}
    assert [[f["properties"]["action"] for f in x.get("fixes", [])] for x in docs["a"]] == [["rename_package"], ["pin_version"]] and "fixes" not in docs["b"][0]
    removed = {r.dep: json.loads(r.document)["runs"][0]["results"] for r in report.sarif(found, patches.withColumn("dep", F.lit("b"))).collect()}
    assert sorted(f["properties"]["action"] for f in removed["b"][0]["fixes"]) == ["remove_dependency", "rename_package"]
    scores = spark.createDataFrame([("a", 2, 90, "critical"), ("b", 1, 1, "low")], "dep string, finding_count long, risk_score long, risk_level string")
    assert report.summary_text(scores).first().text == "2 packages, 3 findings: 1 critical, 0 high, 0 medium, 1 low; highest score 90"
    notes = spark.createDataFrame([("p", "b", 1, ["x"]), ("p", "a", 2, ["y", "z"])], "package string, dep string, n_findings long, categories array<string>")
    assert report.notes_text(notes).first().text == "  p\n    a: 2 findings (y, z)\n    b: 1 findings (x)"


def test_tree(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("a", "b"), ("b", "d"), ("d", "a")], "src string, dst string")
    got = {r.node: (r.children, r.direct, r.depth) for r in graph.tree(nodes, edges, nodes.where("node = 'a'")).collect()}
    assert got == {"a": (["b", "c"], True, 1), "b": (["d"], False, 2), "c": ([], False, 2), "d": (["a"], False, 3), "e": ([], False, 1)}
