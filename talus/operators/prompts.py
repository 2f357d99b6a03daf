"""Lines around findings and review prompts, from numbered lines of flagged files alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.paths import shortened

FIRST_LINES = 200
FILE = ("dep", "path")


def snippets(found: DataFrame, sources: DataFrame, context: int = 0) -> DataFrame:
    """``found`` with snippet: its line and ``context`` lines before and behind, trimmed; empty where the file hasn't them.

    A file's findings meet its text once, in one row; ``sources`` holds a file once.
    """
    rest = [c for c in found.columns if c not in FILE]
    listed = found.groupBy(*FILE).agg(F.collect_list(F.struct(*rest)).alias("items"))
    held = listed.join(sources.select(*FILE, "content"), list(FILE), "left")
    # exploded as one element, so that a text is split once and not for each finding
    held = held.select(*FILE, "items", F.explode(F.array(F.split("content", "\n"))).alias("texts"))

    def with_snippet(x: Column) -> Column:
        begin = F.greatest(x["line"] - context, F.lit(1))
        joined = F.array_join(F.slice("texts", begin, F.greatest(x["line"] + context + 1 - begin, F.lit(0))), "\n")
        return F.struct(*[x[c].alias(c) for c in rest], F.coalesce(F.regexp_replace(joined, r"(?s)^\s+|\s+$", ""), F.lit("")).alias("snippet"))

    each = held.select(*FILE, F.explode(F.transform("items", with_snippet)).alias("x"))
    return each.select(*[c if c in FILE else f"x.{c}" for c in found.columns], "x.snippet")


def _joined(rows: Column, text, between: str) -> Column:
    return F.array_join(F.transform(F.sort_array(rows), text), between)


def prompts(found: DataFrame, sources: DataFrame, packages: DataFrame) -> DataFrame:
    """dep, prompt of each package (dep, version, source) with findings (which hold a description too): what it is, its numbered
    findings by path, line and check, and the first FIRST_LINES lines of each flagged file by path."""
    when = F.when(F.col("compile_time"), " [COMPILE-TIME]").otherwise("")
    said = F.concat(F.lit("["), "severity", when, F.lit("] "), "description", F.lit("\n     File: "), shortened(F.col("path")), F.lit(":"), F.col("line").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("path", "line", "check_id", said.alias("said"))))
    findings = found.groupBy("dep").agg(F.array_join(F.transform(listed, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x["said"])), "\n").alias("findings"))
    flagged = sources.select(*FILE, "content").join(found.select(*FILE).distinct(), list(FILE), "left_semi")
    text = F.concat(F.lit("--- "), shortened(F.col("path")), F.lit(" ---\n"), F.array_join(F.slice(F.split("content", "\n"), 1, FIRST_LINES), "\n"))
    files = flagged.select(*FILE, text.alias("text")).groupBy("dep").agg(_joined(F.collect_list(F.struct("path", "text")), lambda x: x["text"], "\n\n").alias("files"))
    both = findings.join(files, "dep", "left").join(packages, "dep", "left")
    version, source = F.coalesce("version", F.lit("unknown")), F.coalesce("source", F.lit("unknown"))
    prompt = F.concat(
        F.lit("Package "), "dep", F.lit(" "), version, F.lit(" ("), source, F.lit(")\n\nFindings:\n"), "findings", F.lit("\n\nFlagged files:\n"),
        F.coalesce("files", F.lit("  (flagged files not readable)")), F.lit("\n\nJudge each finding, name what else is risky, and give an overall risk.\n"),
    )
    return both.select("dep", prompt.alias("prompt"))
