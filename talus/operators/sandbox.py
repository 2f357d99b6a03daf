"""Findings from sandbox reports of compilation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.paths import outside


def sandbox_findings(reports: DataFrame) -> DataFrame:
    """dep, check_id, target, severity of ``reports`` (dep, available, workdir, denied, written, network, spawned).

    The last four are arrays of strings; a report of an unavailable sandbox says nothing.
    """
    each = lambda check, severity, values: F.transform(values, lambda v: F.struct(F.lit(check).alias("check_id"), v.alias("target"), F.lit(severity).alias("severity")))
    found = F.concat(
        each("sandboxed_compile_denied", "critical", F.col("denied")),
        each("sandboxed_compile_network", "critical", F.col("network")),
        each("sandboxed_compile_subprocess", "warning", F.col("spawned")),
        each("sandboxed_compile_write", "critical", F.filter("written", lambda p: outside(p, F.col("workdir")))),
    )
    return reports.where("available").select("dep", F.inline(found))


def violates() -> Column:
    """Whether a report holds anything outside its policy."""
    return (F.size("denied") > 0) | (F.size("network") > 0) | (F.size("spawned") > 0) | F.exists("written", lambda p: outside(p, F.col("workdir")))


# What lines of a sandbox's output tell of denied calls.
REFUSED = ("Permission denied", "bwrap: Can't ")


def denied_lines(output: Column, kind: str) -> Column:
    """The denied calls that a sandbox's output tells of, in order: structs of op, target and raw (the line).

    ``namespaces``: lines of REFUSED, whose op is denied and whose target isn't known. ``profiles``: lines with Sandbox: and deny;
    behind the first deny stand a count, the op and the target, or the op alone.
    """
    lines = F.split(F.coalesce(output, F.lit("")), "\n")
    if kind == "namespaces":
        hits = F.filter(lines, lambda x: F.contains(x, F.lit(REFUSED[0])) | F.contains(x, F.lit(REFUSED[1])))
        return F.transform(hits, lambda x: F.struct(F.lit("denied").alias("op"), F.lit(None).cast("string").alias("target"), x.alias("raw")))
    if kind != "profiles":
        raise ValueError(f"unknown sandbox {kind}")
    hits = F.filter(lines, lambda x: F.contains(x, F.lit("Sandbox:")) & F.contains(x, F.lit("deny")))
    pieces = lambda x: F.filter(F.split(F.substring(x, F.instr(x, "deny") + F.lit(4), F.char_length(x)), r"\s+"), lambda w: w != "")

    def told(w: Column, x: Column) -> Column:
        op = F.when(F.size(w) > 1, F.get(w, F.lit(1))).otherwise(F.coalesce(F.get(w, F.lit(0)), F.lit("unknown")))
        target = F.when(F.size(w) > 1, F.array_join(F.slice(w, 3, F.greatest(F.lit(0), F.size(w) - 2)), " ")).when(F.size(w) == 1, "")
        return F.struct(op.alias("op"), target.alias("target"), x.alias("raw"))

    return F.transform(hits, lambda x: told(pieces(x), x))
