import pytest

from talus.sources.project import declared_names, lock_entries, read_capabilities, read_locks, read_manifests
from talus.sources.terms import Atom, Unread, declared_capabilities, dependency_names, literal, tokens

LOCK = """%{
  "a": {:hex, :a, "1.2.3", "h1", [:mix], [{:b, "~> 1.0", [hex: :b, repo: "hexpm", optional: false]}], "hexpm", "h2"},
  "b": {:hex, :b, "0.1.0", "only", [:mix], [], "hexpm"},
  "c": {:git, "https://x.org/c.git", "abc123", [branch: "main"]},
  d: {:path, "../d"}, # a comment with } and "
  "e-f": :odd,
  "s" => {:hex, :s, "1", "h", [], [], "hexpm"},
}
"""


def test_literals():
    assert literal('[1, 2.5, :a, "x\\n", nil, %{k: {1}, "s" => []}, [a: 1]]') == [1, 2.5, "a", "x\n", "nil", ("map", [("s", []), ("k", (1,))]), [("a", 1)]]
    assert isinstance(literal(":a"), Atom) and not isinstance(literal('"a"'), Atom)
    for bad in ("", "[1, 2", "{:a", '"x', "foo()", "1 2", "%{a: }", "[1 2]"):
        with pytest.raises(Unread):
            literal(bad)


def test_lock_shapes_and_the_side_output(spark):
    rows = [("x", LOCK), ("cut", LOCK[:80]), ("list", "[1]"), ("empty", ""), ("none", None), ("bare", "%{}")]
    found = spark.createDataFrame(rows, "path string, content string")
    got = sorted(tuple(r) for r in lock_entries(found).collect())
    assert got == sorted(
        [("x", "a", "hex", "1.2.3", "h2", None), ("x", "b", "hex", "0.1.0", "only", None), ("x", "c", "git", "abc123", "abc123", "https://x.org/c.git")]
        + [("x", "d", "hex", None, None, None), ("x", "e-f", "hex", None, None, None)],
        key=repr,
    )
    bad = {r.path for r in read_locks(found).where("reason is not null").collect()}
    assert bad == {"cut", "list", "empty", "none"}


MANIFEST = """
defmodule M do
  def project, do: [app: :m, deps: deps(), scan_capabilities: [:network, :file_read, "x"]]
  defp deps do
    base = [{:phoenix, "~> 1.7"}, {:ecto, ">= 0", only: :dev, path: "p"}]
    if Mix.env() == :dev do
      base ++ [{:tool, git: "https://x"}, {:loc, [path: "../l"], [only: :test]}, jason: "~> 1.0"]
    else
      base |> Enum.map(fn {n, v} -> {n, v} end)
    end ++ [{:only, "x"}, {:weird, :atom}, {:fmt, "#{v}"}, {"str", "1"}]
  end
  defp other, do: [{:not_a_dep, "1"}]
end
"""


def test_dependency_names_of_the_whole_body():
    assert dependency_names(tokens(MANIFEST)) == ["phoenix", "ecto", "tool", "loc", "jason"]
    assert dependency_names(tokens('defp deps, do: [{:a, "1"},\n {:b, "2"}]\n def z, do: [{:c, "3"}]')) == ["a", "b"]
    assert dependency_names(tokens("def nothing do\nend")) == []


def test_capabilities():
    assert declared_capabilities(tokens(MANIFEST), "scan_capabilities") == ["network", "file_read"]
    assert declared_capabilities(tokens("@scan_capabilities [:dns]\n@scan_capabilities [:ssh, :native]"), "scan_capabilities") == ["ssh", "native"]
    assert declared_capabilities(tokens("x = 1"), "scan_capabilities") is None


def test_manifest_side_output(spark):
    found = spark.createDataFrame([("a", MANIFEST), ("cut", MANIFEST[:300]), ("null", None)], "path string, content string")
    assert sorted(r.name for r in declared_names(found).collect()) == ["ecto", "jason", "loc", "phoenix", "tool"]
    assert [r.path for r in read_manifests(found).where("reason is not null").collect()] == ["cut"]
    caps = {r.path: (r.declared, r.reason is None) for r in read_capabilities(found, "scan_capabilities").collect()}
    assert caps == {"a": (["network", "file_read"], True), "cut": (None, False), "null": (None, True)}
