from talus.operators.builtin import allowed, incidents, known_names, transitive_notes, user_allowed
from talus.operators.checks import call_findings
from talus.operators.hooks import hook_findings
from talus.operators.incidents import matching
from talus.operators.report import terminal
from talus.sources.calls import call_facts
from talus.sources.hooks import hooks

HOOKED = '''defmodule Safe do
  defmacro __before_compile__(_env) do
    quote do
      def go, do: :ok
    end
  end
end
defmodule Bad do
  @external_resource "x"
  def __after_compile__(_env, _code) do
    quote do
      def go do
        System.cmd("id", [])
      end
    end
  end
  @after_compile __MODULE__
end
defmodule Uses do
  @before_compile Safe
  @before_compile {Safe, :other}
  # @before_compile Gone
  @before_compile unquote(Elsewhere)
  @after_compile Bad
  @before_compile nil
end
'''
BUILD = "defmodule P do\n  def project do\n    [compilers: [:x] ++ Mix.compilers()]\n  end\nend\n"


def test_hooks_are_looked_up_in_their_own_package(spark):
    rows = [("a", "a/lib/a.ex", HOOKED), ("a", "a/mix.exs", BUILD), ("a", "a/lib/run.ex", BUILD), ("b", "b/lib/b.ex", "defmodule B do\n  @before_compile Safe\nend\n"), ("b", "b/none.ex", None)]
    found = spark.createDataFrame(rows, "dep string, path string, content string")
    got = sorted((r.path, r.line, r.severity) for r in hook_findings(hooks(found), call_facts(found)).collect())
    assert got == [
        ("a/lib/a.ex", 9, "info"),
        ("a/lib/a.ex", 17, "critical"),
        ("a/lib/a.ex", 23, "warning"),
        ("a/lib/a.ex", 24, "critical"),
        ("a/lib/a.ex", 25, "warning"),
        ("a/mix.exs", 3, "critical"),
        ("b/lib/b.ex", 2, "warning"),
    ]


def test_unqualified_calls_follow_imports(spark):
    text = 'defmodule A do\n  cmd("early")\n  import System\n  import :httpc\n  def cmd(x), do: x\n  def f(x) do\n    cmd("id", [])\n    shell "ls"\n    Own.cmd(x)\n    eval_string(x)\n    request(x)\n    # cmd("no")\n    "cmd(no)"\n    get_env()\n  end\nend\n'
    found = spark.createDataFrame([("a.ex", text), ("b.ex", "shell(x)")], "path string, content string")
    got = sorted((r.path, r.line, r.check_id, r.severity) for r in call_findings(call_facts(found)).collect())
    assert got == [("a.ex", 7, "system_exec", "critical"), ("a.ex", 8, "system_exec", "critical"), ("a.ex", 11, "network_access", "warning"), ("a.ex", 14, "env_access", "critical")]


def test_built_in_tables(spark):
    rows = [tuple(r) for r in allowed(spark).collect()]
    assert len(rows) == 81 and len({d for d, _ in rows}) == 46 and ("credo", "system_exec") in rows
    names = known_names(spark)
    assert names.count() == 186 == names.select("name").distinct().count() and names.where("name = 'phoenix'").first().place == 0
    packages = spark.createDataFrame([("phoenx", "1.0.0"), ("phoenix", "1.0.0")], "name string, version string")
    assert [(r.name, r.categories) for r in matching(packages, incidents(spark)).collect()] == [("phoenx", ["phantom_package"])]


def test_user_files_as_list_or_map(spark):
    files = [
        ("a", '# ours\n[{:one, :code_eval}, {:two, :file_access, "reads {x}"}, {"three", :code_eval}]'),
        ("b", '%{allow: [{:four, :env_access, "# kept"}]}'),
        ("c", "%{deny: [{:five, :env_access}]}"),
        ("d", None),
        ("e", "{:six, :env_access}"),
    ]
    got = sorted(map(tuple, user_allowed(spark.createDataFrame(files, "path string, content string")).collect()))
    assert got == [("four", "env_access", "# kept"), ("one", "code_eval", "User allowlisted"), ("two", "file_access", "reads {x}")]


def test_notes_on_what_allowed_packages_reach(spark):
    reached = spark.createDataFrame([("plug", "x"), ("plug", "y"), ("plug", "plug"), ("own", "x")], "package string, dep string")
    found = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "a"), ("plug", "a")], "dep string, category string")
    assert [tuple(r) for r in transitive_notes(reached, found, allowed(spark)).collect()] == [("plug", "x", 3, ["a", "b"])]


def test_terminal_lines(spark):
    scores = spark.createDataFrame([("a", "low", 5), ("b", "high", 60)], "dep string, risk_level string, risk_score int")
    found = spark.createDataFrame([("b", "l.ex", 3, "critical", "runs a command", True)], "dep string, path string, line int, severity string, description string, compile_time boolean")
    assert [r.text for r in terminal(scores, found).collect()] == ["  [HIGH] b score: 60\n    CRITICAL [COMPILE-TIME] runs a command\n      l.ex:3", "  [LOW] a score: 5"]
