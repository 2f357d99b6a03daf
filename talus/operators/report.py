"""Report sinks: SARIF and JSON documents for each package, and diagnostics lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SARIF_VERSION = "2.1.0"


def _level():
    return F.when(F.col("severity") == "critical", "error").when(F.col("severity") == "warning", "warning").otherwise("note")


def _fixes() -> Column:
    """The patches of a package that help with a finding: removal with any, renames with names, others with their own category."""
    helps = lambda p: (
        (p["action"] == "remove_dependency") | (p["action"] == "rename_package") & F.col("category").isin("metadata", "phantom_package") | (p["category"] == F.col("category"))
    )
    shown = lambda p: F.struct(
        F.struct(p["rationale"].alias("text")).alias("description"), F.struct(*[p[c].alias(c) for c in ("action", "target", "version", "verified", "diff")]).alias("properties")
    )
    fixes = F.transform(F.filter("patches", helps), shown)
    return F.when(F.size(fixes) > 0, fixes)


def sarif(found: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """dep and its SARIF document, from (dep, path, line, check_id, severity, description).

    One document a package: a package's findings are gathered, never all findings of a scan. With ``patches`` (dep, action,
    target, version, verified, diff, rationale, category) results carry the fixes that help with them, by category.
    """
    if patches is not None:
        parts = F.struct("action", "target", "version", "verified", "diff", "rationale", "category")
        found = found.join(patches.groupBy("dep").agg(F.sort_array(F.collect_list(parts)).alias("patches")), "dep", "left")
    place = F.struct(
        F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), "line").alias("startLine")).alias("region")).alias("physicalLocation")
    )
    result = F.struct(
        F.col("check_id").alias("ruleId"), _level().alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"), *([] if patches is None else [_fixes().alias("fixes")])
    )
    held = found.groupBy("dep").agg(F.array_sort(F.collect_list(F.struct("path", "line", "check_id", result.alias("result")))).alias("all"))
    results = F.transform("all", lambda x: x["result"])
    rules = F.transform(F.array_sort(F.array_distinct(F.transform("all", lambda x: x["check_id"]))), lambda c: F.struct(c.alias("id")))
    run = F.struct(F.struct(F.struct(F.lit("talus").alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), results.alias("results"))
    return held.select("dep", F.to_json(F.struct(F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs"))).alias("document"))


def diagnostics(found: DataFrame) -> DataFrame:
    """One line a finding: file:line: level: [talus:check] message."""
    level = F.when(F.col("severity") == "critical", "error").when(F.col("severity") == "warning", "warning").otherwise("info")
    return found.select(F.format_string("%s:%d: %s: [talus:%s] %s", "path", "line", level, "check_id", "description").alias("line"))


def terminal(scores: DataFrame, found: DataFrame) -> DataFrame:
    """risk_score, dep, text: what a terminal shows of each package, the highest score first.

    ``scores`` holds dep, risk_level and risk_score; a package's findings follow its own line.
    """
    tag = F.when(F.col("compile_time"), " [COMPILE-TIME]").otherwise("")
    line = F.format_string("    %s%s %s\n      %s:%d", F.upper("severity"), tag, "description", "path", "line")
    each = found.groupBy("dep").agg(F.array_sort(F.collect_list(F.struct("path", "line", line.alias("shown")))).alias("all"))
    head = F.format_string("  [%s] %s score: %s", F.upper("risk_level"), "dep", F.col("risk_score").cast("string"))
    text = F.concat_ws("\n", head, F.transform("all", lambda x: x["shown"]))
    return scores.join(each, "dep", "left").select("risk_score", "dep", text.alias("text")).orderBy(F.desc("risk_score"), "dep")


def notes_text(notes: DataFrame) -> DataFrame:
    """package, text: what each package with an allowance reaches that has findings (package, dep, n_findings, categories)."""
    line = F.format_string("    %s: %d findings (%s)", "dep", "n_findings", F.array_join("categories", ", "))
    held = notes.groupBy("package").agg(F.sort_array(F.collect_list(F.struct("dep", line.alias("line")))).alias("lines"))
    return held.select("package", F.concat_ws("\n", F.concat(F.lit("  "), "package"), F.transform("lines", lambda x: x["line"])).alias("text")).orderBy("package")


def summary_text(scores: DataFrame) -> DataFrame:
    """text: packages, findings, packages by level and the highest score, in one row (finding_count, risk_score, risk_level)."""
    levels = [F.count_if(F.col("risk_level") == x) for x in ("critical", "high", "medium", "low")]
    line = F.format_string(
        "%d packages, %d findings: %d critical, %d high, %d medium, %d low; highest score %d",
        F.count("*"), F.coalesce(F.sum("finding_count"), F.lit(0)), *levels, F.coalesce(F.max("risk_score"), F.lit(0)),
    )
    return scores.agg(line.alias("text"))


def write_report(found: DataFrame, path: str, form: str) -> None:
    """Write findings as sarif, json or diagnostics files below ``path``."""
    if form == "sarif":
        sarif(found).write.mode("overwrite").json(path)
    elif form == "json":
        found.repartitionByRange("dep").sortWithinPartitions("dep").write.mode("overwrite").json(path)
    elif form == "diagnostics":
        diagnostics(found).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown report form {form}")
