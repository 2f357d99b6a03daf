import pytest

from talus.operators.checks import PATTERNS, call_findings, decode_then_eval, dense_literals
from talus.sources.calls import call_facts, literals

EVIL = '''defmodule Evil do
  alias Mint.HTTP, as: Net
  alias Foo.Code
  @x :httpc.request("http://x")
  # System.cmd("no")
  @doc "System.shell is only text"
  defmacro boom do
    System.cmd("id", [])
  end
  def run(a) do
    File.read!("~/.ssh/id_rsa")
    File.read(a)
    System.get_env()
    System.get_env("HOME")
    System.fetch_env!("api_token")
    Net.connect(:https)
    String.to_atom(a)
    Code.eval_string(a)
  end
  String.to_atom("y")
end
'''


def test_rules_on_one_module(spark):
    found = spark.createDataFrame([("evil.ex", EVIL), ("none.ex", None)], "path string, content string")
    got = sorted((r.line, r.check_id, r.severity, r.compile_time) for r in call_findings(call_facts(found)).collect())
    assert got == [
        (4, "network_access", "critical", True),
        (8, "system_exec", "critical", True),
        (11, "file_access", "critical", False),
        (12, "file_access", "warning", False),
        (13, "env_access", "critical", False),
        (14, "env_access", "warning", False),
        (15, "env_access", "critical", False),
        (16, "network_access", "warning", False),
        (17, "atom_exhaustion", "warning", False),
        (20, "atom_exhaustion", "critical", True),
    ]


def test_every_pattern_fires_once(spark):
    rows = [(c, m, f) for c, m, names, _, _ in PATTERNS for f in names.split()]
    name = lambda m: m if m[0].isupper() else ":" + m
    body = "\n".join(f"    {name(m)}.{'any' if f == '*' else f}(x)" for _, m, f in rows)
    found = spark.createDataFrame([("all.ex", f"defmodule A do\n  def f(x) do\n{body}\n  end\nend\n")], "path string, content string")
    got = sorted((r.line, r.check_id) for r in call_findings(call_facts(found)).collect())
    assert got == sorted((3 + i, c) for i, (c, _, _) in enumerate(rows))


@pytest.mark.parametrize("line", ["Enum.map(x, y)", "String.trim(x)", ":lists.sort(x)", "System.os_time()"])
def test_other_calls_stay_quiet(spark, line):
    found = spark.createDataFrame([("a.ex", f"defmodule A do\n  def f(x), do: {line}\nend\n")], "path string, content string")
    assert call_findings(call_facts(found)).collect() == []


def test_obfuscation(spark):
    import base64
    import random

    blob = base64.b64encode(random.Random(1).randbytes(120)).decode()
    code = f"""defmodule A do
  def f(x) do
    y = Base.decode64("{blob}")
    Code.eval_string(y)
  end
  def g(m, x), do: apply(m, :run, [x])
  def h(x), do: apply(:lists, :sort, [x])
  def i(x), do: Base.decode64(x)
  @plain "just a long line of ordinary words that nobody would ever call encoded text"
end
"""
    found = spark.createDataFrame([("a.ex", code)], "path string, content string")
    facts = call_facts(found)
    assert [tuple(r) for r in decode_then_eval(facts).collect()] == [("a.ex", 2)]
    assert [(r.path, r.line) for r in dense_literals(literals(found)).collect()] == [("a.ex", 3)]
    assert [r.line for r in call_findings(facts).collect() if r.check_id == "dynamic_apply"] == [6]
