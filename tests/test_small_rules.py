from pyspark.sql import functions as F

from talus.operators.checks import by_context, raised
from talus.operators.sandbox import denied_lines


def test_denied_lines_of_both_kinds(spark):
    text = "ok\nSandbox: cc(1) deny(1) file-write-create /tmp/a b\nSandbox: x deny\nSandbox: x deny only\ncat: /x: Permission denied\nbwrap: Can't mount\n"
    df = spark.createDataFrame([(text,), (None,)], "o string").select(denied_lines(F.col("o"), "profiles").alias("p"), denied_lines(F.col("o"), "namespaces").alias("n"))
    first, second = df.collect()
    assert [(x.op, x.target) for x in first.p] == [("file-write-create", "/tmp/a b"), ("unknown", None), ("only", "")]
    assert [(x.op, x.target, x.raw) for x in first.n] == [("denied", None, "cat: /x: Permission denied"), ("denied", None, "bwrap: Can't mount")]
    assert second.p == second.n == []


def test_compile_time_by_context(spark):
    rows = [(["module_body"], "a.ex", True), (["module_body", "def"], "a.ex", False), (["module_body", "def", "defmacro"], "a.ex", True), (["def", "module_attribute"], "a.ex", True), (["quote"], "a.ex", False), ([], "mix.exs", True), (["module_body", "defmacro", "quote"], "a.ex", True)]
    df = spark.createDataFrame(rows, "c array<string>, p string, w boolean").withColumn("compile_time", by_context(F.col("c"), F.col("p"))).withColumn("severity", F.lit("warning"))
    assert df.where("compile_time <> w").count() == 0
    assert {(r.compile_time, r.severity) for r in raised(df).collect()} == {(True, "critical"), (False, "warning")}
