import datetime
import json

from pyspark.sql import functions as F

from talus.operators.prompts import prompts, snippets
from talus.sources import registry

RELEASES = [{"version": f"1.{i}.0", "inserted_at": "2024-05-06T07:08:09.5Z"} for i in range(20, 0, -1)]


def read(spark, rows):
    df = spark.createDataFrame([(k, c if c is None or isinstance(c, str) else json.dumps(c), v) for k, c, v in rows], "k string, content string, current string")
    return {r.k: r for r in registry.registry(df).collect()}


def test_registry_answers_of_many_shapes(spark):
    got = read(
        spark,
        [
            ("full", {"downloads": {"all": 12}, "releases": RELEASES, "owners": [1, 2], "meta": {"description": "d"}}, "1.18.0"),
            ("newest", {"releases": RELEASES}, None),
            ("old", {"releases": RELEASES}, "1.5.0"),
            ("first", {"releases": RELEASES}, "1.1.0"),
            ("strange", {"releases": RELEASES}, "9"),
            ("types", {"downloads": {"all": "12"}, "releases": [{"version": 3}, "x", {"version": "1"}], "owners": {"a": 1}, "meta": {"description": 5}}, None),
            ("retired", {"releases": [{"version": "1", "inserted_at": "2024-05-06T07:08:09", "retirement": {}}]}, None),
            ("zone", {"releases": [{"version": "1", "inserted_at": "2024-05-06T07:08:09+02:00", "retirement": None}]}, None),
            ("empty", {}, "1"), ("list", "[]", None), ("cut", '{"releases": [', None), ("null", None, None),
        ],
    )
    part = lambda k, *names: tuple(got[k][n] for n in names)
    assert part("full", "downloads", "latest_version", "previous_version", "lookback_version", "owners", "description", "retired") == (12, "1.20.0", "1.17.0", "1.8.0", 2, "d", False)
    assert part("newest", "previous_version", "lookback_version") == ("1.19.0", "1.10.0")
    assert part("old", "previous_version", "lookback_version") == ("1.4.0", "1.1.0")
    assert part("first", "previous_version", "lookback_version") == (None, "1.1.0") and part("strange", "previous_version", "lookback_version") == (None, None)
    assert part("types", "downloads", "latest_version", "previous_version", "owners", "description") == (0, None, None, None, None)
    assert part("retired", "retired", "released_at") == (True, None)
    assert got["zone"].released_at.astimezone(datetime.timezone.utc).hour == 5 and got["zone"].retired is False
    assert part("empty", "downloads", "latest_version", "owners", "retired", "reason") == (0, None, None, False, None)
    assert {k for k, r in got.items() if r.reason} == {"list", "cut", "null"}


def test_histories_with_bad_records(spark):
    good = {"version": "1", "scan_date": "2024-01-02T03:04:05Z", "finding_count": 2, "categories": ["code_eval", "metadata"], "risk_score": 7}
    rows = [("a", json.dumps([good, {**good, "categories": ["no_such"]}, {**good, "scan_date": "x", "risk_score": None}, {"version": "2"}, 5])), ("b", "{}"), ("c", "["), ("d", None), ("e", "[]")]
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    found = registry.history(spark.createDataFrame(rows, "package string, content string"), now).orderBy("place").collect()
    day = lambda r: r.scan_date.year
    assert [(r.package, r.version, day(r), r.finding_count, r.categories, r.risk_score) for r in found] == [
        ("a", "1", 2024, 2, ["code_eval", "metadata"], 7), ("a", "1", 2030, 2, [], 7), ("a", "1", 2030, 2, ["code_eval", "metadata"], 0), ("a", "2", 2030, 0, [], 0),
    ]


def test_snippets_and_prompts(spark):
    text = "one\n  two\nthree\n\nfive"
    sources = spark.createDataFrame([("a", "x/deps/a/lib/a.ex", text), ("a", "b.ex", "z\n" * 500), ("b", "c.ex", "c")], "dep string, path string, content string")
    schema = "dep string, path string, line int, check_id string, severity string, compile_time boolean, description string"
    path = "x/deps/a/lib/a.ex"
    rows = [("a", path, 2, "k", "critical", True, "D"), ("a", path, 2, "k2", "warning", False, "E"), ("a", path, 5, "k", "info", False, "F"), ("a", path, 99, "k", "info", False, "G"), ("a", "gone.ex", 1, "k", "info", False, "H")]
    found = spark.createDataFrame(rows, schema)
    for context, want in ((0, {2: "two", 5: "five", 99: ""}), (1, {2: "one\n  two\nthree", 5: "five", 99: ""}), (9, {2: text, 5: text, 99: ""})):
        got = snippets(found, sources, context).collect()
        assert len(got) == 5 and {r.line: r.snippet for r in got if r.path == path} == want and [r.snippet for r in got if r.path == "gone.ex"] == [""]
    plan = snippets(found, sources, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and plan.count("Generate") == 2
    made = prompts(found, sources, spark.createDataFrame([("a", None, "git: u")], "dep string, version string, source string")).collect()
    assert [r.dep for r in made] == ["a"] and made[0].prompt.startswith("Package a unknown (git: u)\n\nFindings:\n  1. [info] H\n     File: gone.ex:1\n  2. [critical [COMPILE-TIME]] D\n     File: deps/a/lib/a.ex:2\n")
    assert f"--- deps/a/lib/a.ex ---\n{text}\n" in made[0].prompt and "b.ex" not in made[0].prompt
    long = found.limit(1).withColumn("path", F.lit("b.ex"))
    assert prompts(long, sources, spark.createDataFrame([("a", "1", "hex")], "dep string, version string, source string")).first().prompt.count("z") == 200
