"""Patch suggestions for findings, and their link to reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.versions import minor_of

TYPOSQUAT = r"typosquat of :([a-z][a-z0-9_]*)"


def rename_diff(name: Column, target: Column) -> Column:
    return F.concat(F.lit("-      {:"), name, F.lit(', "~> x.y.z"},\n+      {:'), target, F.lit(', "~> x.y.z"},\n'))


def pin_diff(name: Column, version: Column) -> Column:
    return F.concat(F.lit("-      {:"), name, F.lit(', "~> '), minor_of(version), F.lit('"},\n+      {:'), name, F.lit(', "== '), version, F.lit('"},\n'))


def removal_diff(name: Column) -> Column:
    return F.concat(F.lit("-      {:"), name, F.lit(', "~> x.y.z"},\n'))


def suggestions(findings: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """dep, action, target, version, diff, category, verified: the first patch of each (dep, action, target).

    ``findings`` holds dep, check_id, category, severity, compile_time, description, previous_version, known
    (the nearest known name) and place. ``clean`` (name) lists the packages without findings above info, against
    which renames are verified; without it they stay unverified.
    """
    category = F.col("category")
    near = F.when(F.col("check_id") == "typosquat", F.nullif(F.regexp_extract("description", TYPOSQUAT, 1), F.lit("")))
    near = F.when(F.col("check_id") == "phantom_package", F.col("known")).otherwise(near)
    pins = category.isin("version_transition", "temporal_anomaly") & F.col("previous_version").isNotNull()
    drops = F.col("compile_time") & (F.col("severity") == "critical") & category.isin("system_exec", "code_eval", "compiler_hooks")
    action = (
        F.when(near.isNotNull(), "rename_package")
        .when(F.col("check_id") == "phantom_package", "remove_dependency")
        .when(F.col("check_id") == "typosquat", None)
        .when(pins, "pin_to_version")
        .when(drops, "remove_dependency")
    )
    dep = F.col("dep")
    made = findings.withColumn("action", action).where("action is not null").select(
        "dep",
        "place",
        "action",
        F.when(F.col("action") == "rename_package", near).when(F.col("action") == "pin_to_version", dep).alias("target"),
        F.when(F.col("action") == "pin_to_version", F.col("previous_version")).alias("version"),
        F.when(F.col("action") == "rename_package", rename_diff(dep, near))
        .when(F.col("action") == "pin_to_version", pin_diff(dep, F.col("previous_version")))
        .otherwise(removal_diff(dep))
        .alias("diff"),
        F.when(F.col("action") == "rename_package", "metadata").otherwise(category).alias("category"),
    )
    first = F.row_number().over(Window.partitionBy("dep", "action", "target").orderBy("place"))
    made = made.withColumn("turn", first).where("turn = 1").drop("turn", "place")
    if clean is None:
        return made.withColumn("verified", F.when(F.col("action") != "rename_package", True))
    fine = clean.select(F.col("name").alias("target"), F.lit(True).alias("fine")).distinct()
    return made.join(fine, "target", "left").withColumn("verified", (F.col("action") != "rename_package") | F.coalesce("fine", F.lit(False))).drop("fine")


def fixes(findings: DataFrame, patches: DataFrame) -> DataFrame:
    """``findings`` joined with the patches that a report lists for them: removals for all of a package,
    renames for metadata and phantom findings, others for their own category."""
    p = patches.select("dep", "action", "target", F.col("category").alias("patch_category"))
    fits = (
        (F.col("action") == "remove_dependency")
        | ((F.col("action") == "rename_package") & F.col("category").isin("metadata", "phantom_package"))
        | ((F.col("action") == "pin_to_version") & (F.col("category") == F.col("patch_category")))
    )
    return findings.join(p, "dep").where(fits)
