"""Capabilities: what imports show, what manifests declare, and where they differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Module, function (* for all) and the capabilities that an import of it shows.
SHOWN = (
    ("ssh", "*", "ssh network"),
    ("ssh_sftp", "*", "ssh network"),
    ("ssh_connection", "*", "ssh network"),
    ("ssh_sftpd", "*", "ssh network"),
    ("ftp", "*", "network"),
    ("httpd", "*", "network"),
    ("httpc", "*", "network"),
    ("inets", "*", "network"),
    ("gen_tcp", "*", "network"),
    ("gen_udp", "*", "network"),
    ("gen_sctp", "*", "network"),
    ("ssl", "*", "network"),
    ("socket", "*", "network"),
    ("inet_res", "*", "dns network"),
    ("prim_file", "*", "file_read file_write"),
    ("file", "*", "file_read file_write"),
    ("os", "cmd", "system_exec"),
    ("erlang", "open_port", "system_exec"),
    ("erlang", "spawn_executable", "system_exec"),
    ("erlang", "load_nif", "native"),
    ("erl_eval", "*", "code_eval"),
    ("epp", "*", "code_eval file_read"),
)
KNOWN = ("network", "file_read", "file_write", "system_exec", "code_eval", "native", "compile_hook", "reflection", "ssh", "env_access", "dns")


def observed(imports: DataFrame) -> DataFrame:
    """dep, capability, distinct, of ``imports`` (dep, m, f); the table above is of fixed size and broadcast."""
    spark: SparkSession = imports.sparkSession
    rows = [(m, f, c) for m, f, caps in SHOWN for c in caps.split()]
    dim = F.broadcast(spark.createDataFrame(rows, "m string, shown string, capability string"))
    return imports.join(dim, "m").where((F.col("shown") == "*") | (F.col("shown") == F.col("f"))).select("dep", "capability").distinct()


def mismatches(declared: DataFrame, seen: DataFrame) -> DataFrame:
    """dep, capability, problem: undeclared_use, declared_unused or unknown; packages that declare nothing have none.

    ``declared`` holds (dep, capability); a declared name outside the known ones is unknown.
    """
    owners = declared.select("dep").distinct()
    both = declared.distinct().withColumn("declared", F.lit(True)).join(
        seen.join(owners, "dep", "left_semi").distinct().withColumn("seen", F.lit(True)), ["dep", "capability"], "full_outer"
    )
    problem = (
        F.when(F.col("declared").isNull(), "undeclared_use")
        .when(~F.col("capability").isin(*KNOWN), "unknown")
        .when(F.col("seen").isNull(), "declared_unused")
    )
    return both.select("dep", "capability", problem.alias("problem")).where("problem is not null")
