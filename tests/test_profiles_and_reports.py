import json
import struct

import pytest

from talus.operators.profiles import import_findings, profile_diff, reflection, suspicious_atoms
from talus.operators.report import diagnostics, sarif, write_report
from talus.sources.beam import profiles


def beam(names, imports, exports, compact=False):
    def chunk(name, body):
        return name + struct.pack(">I", len(body)) + body + b"\0" * (-len(body) % 4)

    number = {n: i + 1 for i, n in enumerate(names)}
    length = (lambda n: bytes([n << 4]) if n < 16 else bytes([(n >> 8) << 5 | 8, n & 255])) if compact else (lambda n: bytes([n]))
    table = struct.pack(">i", -len(names) if compact else len(names)) + b"".join(length(len(n.encode())) + n.encode() for n in names)
    imp = struct.pack(">I", len(imports)) + b"".join(struct.pack(">III", number[m], number[f], a) for m, f, a in imports)
    exp = struct.pack(">I", len(exports)) + b"".join(struct.pack(">III", number[f], a, 1) for f, a in exports)
    body = b"BEAM" + chunk(b"AtU8", table) + chunk(b"ImpT", imp) + chunk(b"ExpT", exp)
    return b"FOR1" + struct.pack(">I", len(body)) + body


NAMES = ["mod", "ssh", "connect", "binary_to_term", "run_it", "erlang", "apply", "$handle_undefined_function", "http://evil.example/path", "run"]
IMPORTS = [("ssh", "connect", 3), ("ssh", "connect", 3), ("erlang", "binary_to_term", 1), ("erlang", "apply", 3)]


@pytest.mark.parametrize("compact", [False, True])
def test_profiles_and_their_checks(spark, tmp_path, compact):
    (tmp_path / "a/ebin").mkdir(parents=True)
    (tmp_path / "a/ebin/mod.beam").write_bytes(beam(NAMES, IMPORTS, [("$handle_undefined_function", 2)], compact))
    (tmp_path / "a/ebin/bad.beam").write_bytes(b"FOR1nonsense")
    found = profiles(spark, str(tmp_path)).cache()
    assert [(r.module, len(r.imports), len(r.atoms)) for r in found.collect()] == [("mod", 4, len(NAMES))]
    assert [r.target for r in import_findings(found).collect()] == ["ssh.connect/3"]
    assert sorted(r.finding for r in reflection(found).collect()) == ["decode_and_dispatch", "handle_undefined"]
    assert [r.atom for r in suspicious_atoms(found).collect()] == ["http://evil.example/path"]


def test_profile_difference(spark, tmp_path):
    for side, modules in (("old", {"a": IMPORTS[2:], "b": [], "c": []}), ("new", {"a": IMPORTS, "b": [], "d": IMPORTS[:1]})):
        (tmp_path / side).mkdir()
        for name, imports in modules.items():
            (tmp_path / side / f"{name}.beam").write_bytes(beam([name, *NAMES[1:]], imports, []))
    out = profile_diff(profiles(spark, str(tmp_path / "old")), profiles(spark, str(tmp_path / "new")))
    got = {r.module: (r.status, r.dangerous) for r in out.collect()}
    assert got == {"a": ("changed", ["ssh.connect/3"]), "b": ("same", []), "c": ("removed", []), "d": ("added", ["ssh.connect/3"])}


def test_reports(spark, tmp_path):
    rows = [("d", "lib/a.ex", 0, "code_eval", "critical", "evaluates"), ("d", "lib/a.ex", 7, "env_access", "warning", "reads"), ("e", "x.ex", 2, "env_access", "info", "reads")]
    found = spark.createDataFrame(rows, "dep string, path string, line int, check_id string, severity string, description string")
    docs = {r.dep: json.loads(r.document) for r in sarif(found).collect()}
    run = docs["d"]["runs"][0]
    assert docs["d"]["version"] == "2.1.0" and [x["level"] for x in run["results"]] == ["error", "warning"]
    assert run["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert [x["id"] for x in run["tool"]["driver"]["rules"]] == ["code_eval", "env_access"]
    assert "x.ex:2: info: [talus:env_access] reads" in [r.line for r in diagnostics(found).collect()]
    for form in ("sarif", "json", "diagnostics"):
        write_report(found, f"{tmp_path}/{form}", form)
    assert spark.read.text(f"{tmp_path}/diagnostics").count() == 3
    with pytest.raises(ValueError):
        write_report(found, f"{tmp_path}/x", "pdf")
