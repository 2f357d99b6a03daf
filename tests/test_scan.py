import random

from pyspark.sql import functions as F

from talus.operators import scan
from talus.operators.order import numbered

EVIL = '''defmodule Evil do
  @before_compile Evil
  defmacro __before_compile__(_env) do
    quote do: System.cmd("id", [])
  end
  mod = :httpc
  def steal(f, a) do
    key = File.read!("~/.ssh/id_rsa")
    mod.request(key)
    apply(f, a, [key])
  end
  def run(x), do: x |> Base.decode64() |> Code.eval_string()
  def open(k, d), do: :crypto.crypto_one_time(:aes, k, d, false)
  @blob "q7Zk+Xv2/9LmA0sRt8YcPw4Ue1Ng6Jh3Bi5Do_FxSzVbTyKqWrEuGaHlMjCnOpId-=!$%&()"
end
'''
CLEAN = "defmodule Clean do\n  def a(x), do: String.upcase(x)\n  # System.cmd\nend\n"
TASK = "defmodule Mix.Tasks.Gen do\n  def run(_), do: File.write!(\"a\", \"b\")\nend\n"


def sources(spark):
    rows = [("evil", "deps/evil/lib/evil.ex", EVIL), ("clean", "deps/clean/lib/clean.ex", CLEAN), ("clean", "deps/clean/lib/mix/gen.ex", TASK), ("null", "x.ex", None)]
    return spark.createDataFrame(rows, "dep string, path string, content string")


def test_three_packages_from_text_to_score(spark):
    facts = scan.Facts.of(sources(spark))
    found = scan.correlated(scan.findings(facts))
    got = {(r.dep, r.check_id, r.line): (r.category, r.severity, r.evidence) for r in found.collect()}
    assert got == {
        ("evil", "system_exec", 4): ("system_exec", "critical", 0),
        ("evil", "compiler_hooks", 2): ("compiler_hooks", "critical", 0),
        ("evil", "file_access", 8): ("file_access", "critical", 0),
        ("evil", "network_access", 9): ("network_access", "warning", 0),
        ("evil", "dynamic_apply", 10): ("obfuscation", "critical", 1),
        ("evil", "code_eval", 12): ("code_eval", "critical", 0),
        ("evil", "decode_eval", 12): ("obfuscation", "critical", 0),
        ("evil", "crypto_decrypt", 13): ("obfuscation", "critical", 1),
        ("evil", "entropy", 14): ("obfuscation", "critical", 1),
        ("clean", "file_access", 2): ("file_access", "info", 0),
    }
    allowed = spark.createDataFrame([("evil", "file_access"), ("clean", "file_access")], "dep string, category string")
    more = found.where("check_id = 'file_access' and dep = 'clean'").withColumn("check_id", F.lit("version_transition"))
    kept = scan.scanned(scan.findings(facts), allowed, more)
    assert {(r.dep, r.check_id) for r in kept.collect()} == {(d, c) for d, c, _ in got if c != "file_access"} | {("clean", "version_transition")}
    scored = {r.dep: (r.finding_count, r.risk_score, r.risk_level) for r in scan.scores(kept).collect()}
    assert scored == {"evil": (8, 100, "critical"), "clean": (1, 1, "low")}


def test_known_incidents_promote(spark):
    facts = scan.Facts.of(sources(spark))
    packages = spark.createDataFrame([("evil", "1.0.0"), ("clean", "1.0.0")], "name string, version string")
    known = spark.createDataFrame([("evil", "lt", "2.0.0", None, ["network_access"], None)], "name string, op string, low string, high string, categories array<string>, check_ids array<string>")
    allowed = spark.createDataFrame([], "dep string, category string")
    out = scan.scanned(scan.findings(facts), allowed, packages=packages, known=known)
    assert {r.check_id for r in out.where("evidence = 4").collect()} == {"network_access"}


def test_a_users_check_joins_the_scan_over_the_same_facts(spark):
    @scan.check("upcase")
    def upcase(facts):
        hit = facts.calls.where("func = 'upcase'")
        return hit.select("dep", "path", "line", F.lit("upcase").alias("check_id"), F.lit("info").alias("severity"), "compile_time", F.lit("style").alias("category"))

    try:
        found = scan.findings(scan.Facts.of(sources(spark)))
        assert [tuple(r)[:5] for r in found.where("check_id = 'upcase'").collect()] == [("clean", "deps/clean/lib/clean.ex", 2, "upcase", "style")]
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString().replace("ArrowEvalPython", "")
        assert scan.findings(scan.Facts.of(sources(spark)), ("upcase",)).count() == 1
    finally:
        del scan.CHECKS["upcase"]


def test_places_equal_a_sort_whatever_the_partitions(spark):
    r = random.Random(4)
    rows = [(r.choice([None, *range(40)]), r.choice("ab")) for _ in range(3000)] + [(7, "a")] * 2000
    df = spark.createDataFrame(rows, "k int, v string")
    for parts in (1, 9):
        got = sorted(numbered(df.repartition(parts), F.desc_nulls_last("k"), "v").collect(), key=lambda x: x.ordinal)
        assert [x.ordinal for x in got] == list(range(1, 5001))
        assert [(x.k, x.v) for x in got] == sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert numbered(df.limit(0), "k").count() == 0


def test_report_order_is_stable_over_repartitioning(spark):
    df = spark.createDataFrame([(f"d{i}", i % 3) for i in range(200)], "dep string, risk_score int")
    a, b = ({x.dep: x.place for x in numbered(df.repartition(n), F.desc("risk_score"), "dep", name="place").collect()} for n in (2, 7))
    assert a == b
