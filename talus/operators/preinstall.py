"""Judging packages before they are installed: registry, similar names, version steps, and one line on each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.operators.names import confusables

FEW_DOWNLOADS, RECENT_DAYS = 1000, 7


def _gathered(rows: DataFrame, order: list[str], text: Column, name: str) -> DataFrame:
    held = F.sort_array(F.collect_list(F.struct(*order, text.alias("text"))))
    return rows.groupBy("package").agg(F.transform(held, lambda x: x["text"]).alias(name))


def similar_names(packages: DataFrame, corpus: DataFrame) -> DataFrame:
    """package, similar: what is said of each well-known name (name, place) that it may be taken for, in their order."""
    near = confusables(packages.select(F.col("package").alias("name")), corpus).join(corpus.groupBy(F.col("name").alias("known")).agg(F.min("place").alias("place")), "known")
    text = F.format_string("similar to %s (%s)", "known", "kind")
    return _gathered(near.select(F.col("name").alias("package"), "known", "kind", "place"), ["place", "known"], text, "similar")


def _warnings() -> Column:
    """The warnings of a known or unreachable package, the last one found first."""
    days = F.col("days")
    return F.array_compact(
        F.array(
            F.when(days < RECENT_DAYS, F.format_string("Latest version published %d days ago", days)),
            F.when(F.size("transitions") > 0, "Suspicious version transition"),
            F.when(F.size("similar") > 0, "Possible typosquat"),
            F.when(F.col("answered") & (F.coalesce("description", F.lit("")) == ""), "No package description"),
            F.when(F.col("retired"), "Package is retired"),
            F.when(F.col("owners") == 1, "Single package owner"),
            F.when(F.col("downloads") < FEW_DOWNLOADS, F.format_string("Low download count (%d)", "downloads")),
        )
    )


def assessed(packages: DataFrame, answers: DataFrame, corpus: DataFrame, steps: DataFrame) -> DataFrame:
    """package, phantom, similar, transitions, assessment and warned of distinct ``packages`` (package).

    ``answers`` holds package, status (200 or 404) and for 200 downloads, owners, retired, description, days (since the newest
    version), previous_version and latest_version; a package without a row couldn't be asked for, which says nothing
    against it. ``steps`` holds package, signal: what its newest version changed. Corpus: name, place.
    """
    asked = packages.select("package").distinct().join(answers, "package", "left")
    answered = F.coalesce(F.col("status") == 200, F.lit(False))
    asked = asked.withColumns({"answered": answered, "phantom": F.coalesce(F.col("status") == 404, F.lit(False))})
    known = asked.where("answered and latest_version is not null and previous_version is not null").select("package", "previous_version", "latest_version")
    moved = _gathered(known.join(steps, "package"), ["signal"], F.format_string("Version %s → %s: %s", "previous_version", "latest_version", "signal"), "transitions")
    none = F.array().cast("array<string>")
    held = asked.join(similar_names(packages, corpus), "package", "left").join(moved, "package", "left")
    held = held.withColumns({"similar": F.coalesce("similar", none), "transitions": F.coalesce("transitions", none)}).withColumn("found", _warnings())
    missing = F.when(
        F.size("similar") > 0, F.concat(F.lit(" Also similar to known packages: "), F.array_join("similar", "; "), F.lit(". Likely slopsquatting target."))
    ).otherwise(" Verify the package name is correct before installing.")
    line = (
        F.when(F.col("phantom"), F.concat(F.lit("CRITICAL: Package does not exist on hex.pm."), missing))
        .when(F.size("found") == 0, "No concerns identified.")
        .otherwise(F.concat(F.lit("Warnings: "), F.array_join("found", "; ")))
    )
    few, owner, gone, new = (F.coalesce(x, F.lit(False)) for x in (F.col("downloads") < FEW_DOWNLOADS, F.col("owners") == 1, F.col("retired"), F.col("days") < RECENT_DAYS))
    warned = F.col("phantom") | (F.size("similar") > 0) | (F.size("transitions") > 0) | few | owner | gone | new
    return held.select("package", "phantom", "similar", "transitions", line.alias("assessment"), warned.alias("warned"))


def warned(reports: DataFrame) -> DataFrame:
    return reports.where("warned")


def stops(reports: DataFrame) -> DataFrame:
    """One row: whether any package doesn't exist."""
    return reports.agg(F.coalesce(F.bool_or("phantom"), F.lit(False)).alias("critical"))
