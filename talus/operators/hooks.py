"""Findings about compile-time hooks: each hook is looked up among its package's callbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Calls that make a callback dangerous. Columns: module, functions (* for all).
DANGEROUS = (
    ("System", "cmd shell"),
    ("os", "cmd"),
    ("Code", "eval_string eval_quoted eval_file compile_string compile_quoted compile_file require_file"),
    ("EEx", "eval_string eval_file compile_string compile_file"),
    ("erlang", "binary_to_term open_port spawn_executable"),
    ("Port", "open"),
    ("Module", "create"),
    ("Req", "*"),
    ("HTTPoison", "*"),
    ("Finch", "*"),
    ("Tesla", "*"),
    ("Mojito", "*"),
    ("httpc", "*"),
    ("gen_tcp", "connect"),
    ("ssl", "connect"),
)


def dangerous_calls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, f) for m, names in DANGEROUS for f in names.split()], "module string, func string")


def judged_callbacks(callbacks: DataFrame, facts: DataFrame) -> DataFrame:
    """dep, module, event, dangerous of the callbacks (dep, path, module, event, line, last) by the call facts (dep, path, line, module, func) in their lines.

    Where a package defines a callback of one module more than once, one dangerous body is enough.
    """
    # the table above, of fixed size
    dim = F.broadcast(dangerous_calls(facts.sparkSession).withColumnRenamed("module", "m").withColumnRenamed("func", "f"))
    calls = facts.join(dim, (F.col("module") == F.col("m")) & F.col("f").isin("*", F.col("func")), "left_semi")
    calls = calls.select("dep", "path", F.col("line").alias("at")).distinct()
    inside = (callbacks.dep == calls.dep) & (callbacks.path == calls.path) & F.col("at").between(callbacks.line, callbacks.last)
    held = callbacks.join(calls, inside, "left").select(callbacks["dep"], "module", "event", F.col("at").isNotNull().alias("bad"))
    return held.groupBy("dep", "module", "event").agg(F.bool_or("bad").alias("dangerous"))


def hook_findings(found: DataFrame, facts: DataFrame) -> DataFrame:
    """dep, path, line, check_id, severity, compile_time of ``found`` (rows of ``sources.hooks``).

    A hook whose callback isn't in the package is a warning, one with a dangerous callback critical, any
    other none. External resources are info; compilers named in mix.exs are critical.
    """
    known = judged_callbacks(found.where("kind = 'callback'"), facts)
    hook = found.where("kind = 'hook'").join(known, ["dep", "module", "event"], "left")
    hook = hook.withColumn("severity", F.when(F.col("dangerous").isNull(), "warning").when(F.col("dangerous"), "critical")).where("severity is not null")
    plain = found.where("kind = 'resource' or kind = 'compilers' and path rlike '(^|/)mix[.]exs$'")
    plain = plain.withColumn("severity", F.when(F.col("kind") == "resource", "info").otherwise("critical"))
    columns = ["dep", "path", "line", F.lit("compiler_hooks").alias("check_id"), "severity", F.lit(True).alias("compile_time")]
    return hook.select(*columns).unionByName(plain.select(*columns))
