from pyspark.sql import functions as F

from talus.functions import paths
from talus.functions.versions import version_key, version_matches
from talus.operators import capabilities, incidents, links, metadata, native, patches, profiles, review, sandbox, service, transitions


def test_all_link_patterns_and_exceptions(spark):
    good = [
        "u = \"https://a.b.xyz/x\"", "https://q.tk/", "http://q.ml/x", "http://q.ga/x", "http://q.cf/x", "x.ngrok.io", "serveo.net", "ssh localhost.run", "pastebin.com/raw",
        "api.telegram.org/bot", "discord.com/api/webhooks/1", "RequestBin", "http://10.0.0.1:80",
    ]
    bad = ["# http://q.tk/", "  # pastebin.com", "{~r/ngrok\\.io/, 1}", "https://example.com/xyz", "http://a.xyzz/", "https://hexdocs.pm/"]
    lines = spark.createDataFrame([("lib/a.ex", x) for x in good + bad] + [("test/a.ex", good[0])], "path string, line string")
    got = links.shady_links(lines, "path").collect()
    assert sorted(r.line for r in got) == sorted(good) and len({r.reason for r in got}) == len(links.LINKS)


def test_versions_order_as_the_rules_say(spark):
    order = ["0.9.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.9.0", "1.10.0"]
    frame = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r.v for r in frame.orderBy(version_key(F.col("v"))).collect()] == order
    rows = [("any", None, None, None, True), ("eq", "1.0", None, "1.0", True), ("lt", "1.10.0", None, "1.9.0", True), ("lte", "1.0.0", None, "1.0.0+b", True), ("gte", "1.0.0", None, "1.0.0-rc.1", False), ("range", "1.0.0", "2.0.0", "1.5.0", True), ("range", "1.0.0", "2.0.0", "x", False), ("lt", "2.0.0", None, "01.0.0", False), ("gte", "1.0.0", None, None, False)]
    frame = spark.createDataFrame(rows, "op string, lo string, hi string, v string, want boolean")
    assert frame.where(version_matches(F.col("op"), F.col("lo"), F.col("hi"), F.col("v")) != F.col("want")).count() == 0


def test_incidents_promote_only_what_their_signature_holds(spark):
    packages = spark.createDataFrame([("a", "1.0.1"), ("b", "2.0.0"), ("c", None)], "name string, version string")
    known = spark.createDataFrame([("a", "lt", "1.1.0", None, ["code_eval"], None), ("b", "lt", "2.0.0", None, None, None), ("c", "any", None, None, None, ["x"])], "name string, op string, low string, high string, categories array<string>, check_ids array<string>")
    found = spark.createDataFrame([("a", "code_eval", "x", "p"), ("a", "other", "x", "p"), ("b", "code_eval", "x", "p"), ("c", "o", "x", "p"), ("c", "o", "y", "p"), ("a", "code_eval", "x", "p")], "name string, category string, check_id string, evidence string")
    got = sorted((r.name, r.category, r.check_id, r.evidence) for r in incidents.promoted(found, packages, known).collect())
    assert got == [("a", "code_eval", "x", "known_incident")] * 2 + [("a", "other", "x", "p"), ("b", "code_eval", "x", "p"), ("c", "o", "x", "known_incident"), ("c", "o", "y", "p")]


def test_judgments_are_read_and_applied(spark):
    text = "Finding #1: confirmed\nfinding #2: REFUTED because\nFINDING #2: uncertain\nFINDING #3: REFUTED\nFINDING #x: REFUTED\nOverall: Malicious\nOVERALL: BENIGN"
    reviews = spark.createDataFrame([("d", text), ("e", "nothing"), ("f", None)], "dep string, text string")
    given = review.verdicts(reviews, "dep", "text")
    assert {(r.dep, r.position): r.verdict for r in given.collect()} == {("d", 1): "confirmed", ("d", 2): "uncertain", ("d", 3): "refuted"}
    assert {r.dep: r.overall for r in review.overall(reviews, "dep", "text").collect()}["d"] == "malicious"
    found = spark.createDataFrame([("d", i, s, "pattern_match") for i, s in enumerate(["critical", "warning", "critical", "info"])] + [("e", 0, "warning", "pattern_match")], "dep string, line int, severity string, evidence string")
    got = [(r.severity, r.evidence) for r in review.judged(found, given, "dep", ["line"]).orderBy("dep", "line").collect()]
    assert got == [("critical", "llm_confirmed"), ("warning", "pattern_match"), ("warning", "pattern_match"), ("info", "pattern_match"), ("warning", "pattern_match")]


def test_native_sandbox_and_service_rules(spark):
    files = [("d", "priv/a/x.so", None), ("d", "lib/x.so", None), ("d", "c_src/a.c", ""), ("d", "c_src/b.c", ""), ("d", "Makefile", ""), ("d", "sub/Makefile", ""), ("d", "mix.exs", "compilers: [:rustler]"), ("e", "mix.exs", "x")]
    got = sorted((r.check_id, r.target) for r in native.native_findings(spark.createDataFrame(files, "dep string, path string, content string")).collect())
    assert got == [("native_code_artifact", "priv/a/x.so"), ("native_code_build_file", "Makefile"), ("native_code_compiler", "mix.exs"), ("native_code_source", "c_src")]
    reports = spark.createDataFrame([("d", True, "/w", ["open"], ["/w/a", "/etc/x"], ["h:1"], ["sh"]), ("e", False, "/w", ["open"], [], [], []), ("f", True, "/w", [], ["/w/b"], [], [])], "dep string, available boolean, workdir string, denied array<string>, written array<string>, network array<string>, spawned array<string>")
    assert sorted((r.dep, r.check_id[18:], r.target) for r in sandbox.sandbox_findings(reports).collect()) == [("d", "denied", "open"), ("d", "network", "h:1"), ("d", "subprocess", "sh"), ("d", "write", "/etc/x")]
    assert [r.dep for r in reports.where(sandbox.violates()).orderBy("dep").collect()] == ["d", "e"]
    scans = spark.createDataFrame([("completed", "low", 0.5), ("done", "low", 0.5), ("failed", None, 0.5), ("failed", "low", 1.5), ("failed", "low", None)], "status string, risk_level string, ratio double")
    fine, bad = service.parted(scans)
    assert fine.count() == 1 and sorted(r.problem for r in bad.collect()) == ["ratio", "ratio", "risk_level", "status"]


def test_patches_and_fixes(spark):
    rows = [
        ("reqq", "typosquat", "metadata", "warning", False, "likely typosquat of :req here", None, None, 0),
        ("reqq", "typosquat", "metadata", "warning", False, "likely typosquat of :req again", None, None, 1),
        ("ghost", "phantom_package", "metadata", "critical", False, "", None, None, 0),
        ("plugg", "phantom_package", "metadata", "critical", False, "", None, "plug", 0),
        ("old", "x", "version_transition", "warning", False, "", "1.2.3", None, 0),
        ("old", "x", "temporal_anomaly", "warning", False, "", None, None, 1),
        ("bad", "x", "code_eval", "critical", True, "", None, None, 0),
        ("bad", "x", "env_access", "critical", True, "", None, None, 1),
    ]
    found = spark.createDataFrame(rows, "dep string, check_id string, category string, severity string, compile_time boolean, description string, previous_version string, known string, place int")
    made = {(r.dep, r.action): r for r in patches.suggestions(found, spark.createDataFrame([("req",)], "name string")).collect()}
    assert set(made) == {("reqq", "rename_package"), ("ghost", "remove_dependency"), ("plugg", "rename_package"), ("old", "pin_to_version"), ("bad", "remove_dependency")}
    assert made["reqq", "rename_package"].verified and not made["plugg", "rename_package"].verified
    assert made["old", "pin_to_version"].diff == '-      {:old, "~> 1.2"},\n+      {:old, "== 1.2.3"},\n'
    fits = patches.fixes(found.select("dep", "category", "place"), patches.suggestions(found))
    assert fits.where("dep = 'bad'").count() == 2 and fits.where("dep = 'old'").count() == 1


def test_transitions_capabilities_and_metadata(spark):
    old, new = spark.createDataFrame([("a", "lib/x")], "dep string, path string"), spark.createDataFrame([("a", "lib/x"), ("a", "lib/y"), ("a", "test/z")], "dep string, path string")
    assert [tuple(r) for r in transitions.unexpected_files(old, new).collect()] == [("a", 1)]
    steps = spark.createDataFrame([("a", "3", "2", "1"), ("b", "3", "2", "2"), ("c", "3", None, "3")], "dep string, current string, previous string, lookback string")
    signals = spark.createDataFrame([(d, w, "profile_shift") for d in "abc" for w in ("previous", "lookback")], "dep string, against string, signal string")
    assert sorted((r.dep, r.check_id, r.severity) for r in transitions.transition_findings(steps, signals).collect()) == [("a", "version_lookback", "warning"), ("a", "version_transition", "critical"), ("b", "version_transition", "critical")]
    seen = capabilities.observed(spark.createDataFrame([("a", "ssh", "connect"), ("a", "os", "cmd"), ("a", "os", "getenv"), ("b", "file", "open")], "dep string, m string, f string"))
    declared = spark.createDataFrame([("a", "network"), ("a", "dns"), ("a", "magic")], "dep string, capability string")
    assert {(r.capability, r.problem) for r in capabilities.mismatches(declared, seen).collect()} == {("ssh", "undeclared_use"), ("system_exec", "undeclared_use"), ("dns", "declared_unused"), ("magic", "unknown")}
    meta = spark.createDataFrame([(True, "git", 50, 3, 1, "", 5, False), (True, "hex", 999, None, 2, "d", 3, None), (False, "git", 1, 1, 1, "", 9, True)], "known boolean, source string, downloads long, days int, owners int, description string, depth int, retired boolean")
    assert [r[0] for r in meta.select(metadata.penalty(meta)).collect()] == [65, 15, 0]
    assert [r[0] for r in meta.select(metadata.has_warnings()).collect()] == [True, True, True]


def test_density_delta_and_hash_of_modules(spark):
    schema = "path string, module string, imports array<struct<m:string,f:string,a:int>>, exports array<struct<f:string,a:int>>, atoms array<string>, dispatch int"
    five = [("erlang", "apply", 2), ("erlang", "apply", 3), ("erlang", "make_fun", 3), ("erlang", "fun_info", 1), ("erlang", "fun_info", 2)]
    old = spark.createDataFrame([("p", "m", [], [], ["x"], 0), ("p", "g", [], [], [], 0)], schema)
    new = spark.createDataFrame([("p", "m", [*five, ("os", "cmd", 1)], [("$handle_undefined_function", 2)], ["x", "evil.example.com", "1.2.3.4"], 15), ("p", "n", five[:2] + [("inets", "start", 0)], [], [], 14), ("p", "g", [], [], [], 0)], schema)
    assert [(r.module, r.kinds, r.severity) for r in profiles.reflection_density(new).collect()] == [("m", 5, "critical")]
    got = sorted((r.module, r.check_id[11:], tuple(r.examples)) for r in profiles.delta_findings(old, new).collect())
    assert got == [("m", "dangerous_import", ("os.cmd/1",)), ("m", "dispatch_spike", ()), ("m", "handle_undefined", ()), ("m", "suspicious_atoms", ("1.2.3.4", "evil.example.com")), ("n", "dangerous_import", ("inets.start/0",)), ("n", "module_added", ())]
    turned = spark.createDataFrame([("q", "m", list(reversed([*five, ("os", "cmd", 1)])), [("$handle_undefined_function", 2)], ["1.2.3.4", "x", "evil.example.com"], 1)], schema)
    assert profiles.content_hash(turned).first().hash == profiles.content_hash(new).where("module = 'm'").first().hash


def test_texts_and_keys(spark):
    row = spark.createDataFrame([("/a/deps/x/lib.ex", "/b/c.ex", "A b/c", "one\ntwo here\nthree", "two")], "p string, q string, m string, t string, l string")
    got = row.select(paths.shortened(F.col("p")), paths.shortened(F.col("q")), paths.slug(F.col("m")), paths.line_of(F.col("t"), F.col("l")), paths.line_of(F.col("t"), F.lit("none")), paths.base_name(F.col("q"))).first()
    assert tuple(got) == ("deps/x/lib.ex", "/b/c.ex", "A_b_c", 2, 1, "c.ex")
    keys = spark.createDataFrame([(bytes(range(32)),), (bytes([255] * 32),), (b"short",)], "k binary")
    back = keys.select("k", paths.encoded_key("pub", F.col("k")).alias("t")).select("k", "t", paths.decoded_key("pub", F.col("t")).alias("b"), paths.decoded_key("sec", F.col("t")).alias("s")).collect()
    assert [bytes(r.b) if r.b else None for r in back] == [bytes(range(32)), bytes([255] * 32), None] and not any(r.s for r in back)
    assert "=" not in back[1].t and "/" not in back[1].t


def test_a_retried_batch_replaces_itself(spark, tmp_path):
    from talus.streaming.rollup import projection

    write = projection(str(tmp_path))
    one = spark.createDataFrame([("a", "1", 5), ("b", "1", 7)], "package string, version string, score int")
    write(one, 0), write(one, 0), write(one.limit(1), 1)
    for name in ("package_scans", "risk_timeline"):
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 3
