from pyspark.sql import functions as F

from talus.functions.versions import version_key
from talus.operators.capabilities import mismatches
from talus.operators.checks import call_findings
from talus.operators.hooks import hook_findings
from talus.operators.names import confusables, nearest_known
from talus.operators.profiles import delta_findings
from talus.operators.review import verdicts
from talus.sources.calls import Definitions, call_facts, masked
from talus.sources.hooks import hooks

HOOK = "defmodule M do\n  @before_compile M\n  defmacro __before_compile__(_) do\n    {}\n  end\nend\n"


def test_hooks_are_judged_by_their_own_package(spark):
    rows = [("a", "lib/m.ex", HOOK.format("quote do: 1")), ("b", "lib/m.ex", HOOK.format('System.cmd("x", [])'))]
    found = spark.createDataFrame(rows, "dep string, path string, content string")
    got = [(r.dep, r.severity) for r in hook_findings(hooks(found), call_facts(found)).collect()]
    assert got == [("b", "critical")]


def test_bound_modules_and_blocks(spark):
    text = """defmodule M do
  m = System
  def a(x), do: m.cmd("id", [])
  def b do m = :os; m.cmd('id'); if x, do: 1
  end
  defmacro c(x,
             y) do
    fn -> m.cmd('x') end
  end
  def d(), do:
    File.read("/etc/passwd")
  alias Code, as: K
  m = K
  def e, do: m.eval_string("1")
  x = nil
  y == System
  def f(y), do: y.cmd("no")
  m.eval_string "2"
  K.eval_string("3")
end
"""
    facts = call_facts(spark.createDataFrame([("a.ex", text)], "path string, content string"))
    got = sorted((r.line, r.module, r.func, r.body, r.compile_time) for r in facts.collect())
    assert got == [
        (3, "System", "cmd", 3, False), (4, "os", "cmd", 4, False), (8, "os", "cmd", 6, True), (11, "File", "read", 10, False),
        (14, "K", "eval_string", 14, False), (18, "K", "eval_string", 0, True), (19, "Code", "eval_string", 0, True),
    ]


def test_nested_definitions_and_large_files():
    d = Definitions(masked("defmacro a do\n  quote do\n    def b do\n      x\n    end\n  end\nend\ny\n"))
    assert d.at(45) == (29, True) and d.at(70) == (-1, True)
    text = "defmodule M do\n" + "".join(f"  def f{i}(x) do\n    System.cmd(x, [])\n  end\n" for i in range(20_000)) + "end\n"
    assert len(Definitions(masked(text)).spans) == 20_000


def test_long_argument_lists_are_read_to_their_bracket(spark):
    text = f'defmodule M do\n  def a, do: File.read(f("{"x" * 5000}", "~/.ssh/id_rsa"))\nend\n'
    got = call_findings(call_facts(spark.createDataFrame([("a.ex", text)], "path string, content string"))).collect()
    assert [(r.check_id, r.severity) for r in got] == [("file_access", "critical")]


def test_every_known_capability(spark):
    names = ["compile_hook", "reflection", "env_access", "telepathy"]
    declared = spark.createDataFrame([("a", n) for n in names], "dep string, capability string")
    got = {r.capability: r.problem for r in mismatches(declared, declared.limit(0)).collect()}
    assert got == {n: "declared_unused" for n in names[:3]} | {"telepathy": "unknown"}


def test_version_parts_and_finding_numbers_of_any_length(spark):
    long = "9" * 40
    rows = [f"1.{long}.0", f"1.1{long}.0", "1.2.0", f"1.2.0-a.{long}", f"1.2.0-a.1{'0' * 40}", "1.2.0-a.9"]
    got = [r.v for r in spark.createDataFrame([(v,) for v in rows], "v string").orderBy(version_key(F.col("v"))).collect()]
    assert got == ["1.2.0-a.9", f"1.2.0-a.{long}", f"1.2.0-a.1{'0' * 40}", "1.2.0", f"1.{long}.0", f"1.1{long}.0"]
    review = spark.createDataFrame([(1, "FINDING #99999999999999999999: CONFIRMED\nFINDING #2: refuted")], "k int, text string")
    assert {(r.position, r.verdict) for r in verdicts(review, "k", "text").collect()} == {(None, "confirmed"), (2, "refuted")}


def test_deltas_spike_from_three_and_name_each_import_of_a_new_module(spark):
    schema = "path string, module string, imports array<struct<m:string,f:string,a:int>>, exports array<struct<f:string,a:int>>, atoms array<string>, dispatch int"
    bad = [("os", "cmd", 1), ("erlang", "open_port", 2), ("ssh", "connect", 3), ("prim_file", "open", 4)]
    old = spark.createDataFrame([("e", "A", [], [], [], 2), ("e", "B", [], [], [], 2)], schema)
    new = spark.createDataFrame([("e", "A", [], [], [], 4), ("e", "B", bad, [], [], 5), ("e", "C", bad[:1] + bad[2:], [], [], 9)], schema)
    got = sorted((r.module, r.check_id[11:], len(r.examples)) for r in delta_findings(old, new).collect())
    assert got == [("B", "dangerous_import", 3), ("B", "dispatch_spike", 0), *[("C", "dangerous_import", 1)] * 3, ("C", "module_added", 0)]


def test_names_by_variants_equal_all_pairs(spark):
    names = ["jason", "json", "jsno", "jaosn", "phoenix", "phoneix", "pheonix", "a-b-c", "a_b.c", "abc", "ab c", "x", "y", "", "plug", "plugs", "gulp"]
    corpus = spark.createDataFrame([(n, 100 - i) for i, n in enumerate(names)], "name string, place int")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            held, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                held, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, held + (x != y))
        return row[-1]

    def kind(a, b):
        plain = lambda s: "".join(c for c in s if c not in "-_.")
        apart = [i for i in range(min(len(a), len(b))) if a[i] != b[i]]
        swap = len(a) == len(b) and len(apart) == 2 and apart[1] == apart[0] + 1 and a[apart[0]] == b[apart[1]] and a[apart[1]] == b[apart[0]]
        return "edit" if lev(a, b) == 1 else "swap" if swap else "separator" if plain(a) == plain(b) else None

    want = {(a, b, kind(a, b)) for a in names for b in names if a != b and kind(a, b)}
    assert {tuple(r) for r in confusables(corpus, corpus).collect()} == want
    place = {n: 100 - i for i, n in enumerate(names)}
    near = {}
    for a in names:
        found = sorted((lev(a, b), place[b], b) for b in names if a != b and lev(a, b) <= 2)
        if found:
            near[a] = (found[0][2], found[0][0])
    assert {r.name: (r.known, r.distance) for r in nearest_known(corpus, corpus).collect()} == near
