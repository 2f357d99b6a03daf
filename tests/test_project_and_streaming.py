from talus.sources.project import declared_names, files, lock_entries
from talus.streaming.rollup import folded, parsed

LOCK = """%{
  "jason": {:hex, :jason, "1.4.0", "HASH1", [:mix], [], "hexpm", "HASH2"},
  "local": {:path, "../local"},
  "gitty": {:git, "https://host.example/x.git", "abc123", [branch: "main"]},
}
""".replace("HASH1", "a" * 64).replace("HASH2", "b" * 64)


def test_lock_and_manifest(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/mix.lock").write_text(LOCK)
    (tmp_path / "mix.lock").write_text("not a map")
    (tmp_path / "mix.exs").write_text("defmodule M do\n  defp deps do\n    [{:jason, \"~> 1.0\"}, {:plug, path: \"x\"}]\n  end\nend\n")
    rows = {r.name: (r.source, r.version, r.hash, r.url) for r in lock_entries(files(spark, str(tmp_path), "mix.lock")).collect()}
    assert rows == {
        "jason": ("hex", "1.4.0", "b" * 64, None),
        "local": ("hex", None, None, None),
        "gitty": ("git", "abc123", "abc123", "https://host.example/x.git"),
    }
    assert sorted(r.name for r in declared_names(files(spark, str(tmp_path), "mix.exs")).collect()) == ["jason", "plug"]


def test_publish_events_are_parsed_or_set_aside(spark):
    raw = spark.createDataFrame([('{"package":"a","version":"1","score":3}',), ("{",), ('{"package":"a"}',)], "value string")
    good, bad = parsed(raw)
    assert [tuple(r) for r in good.collect()] == [("a", "1", 3)] and bad.count() == 2


def test_commands_fold_into_state(spark, tmp_path):
    rows = [("a", "scan", None), ("a", "suppress", "f"), ("a", "suppress", "f"), ("b", "attest", None)]
    spark.createDataFrame(rows, "package_name string, kind string, finding string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("package_name string, kind string, finding string").parquet(f"{tmp_path}/in")
    q = folded(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select * from folded").collect())) == [("a", 1, 0, 1, 1), ("b", 0, 1, 0, 0)]
