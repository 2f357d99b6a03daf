"""Known incidents: matching versions and promoting findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions.versions import version_matches


def matching(packages: DataFrame, incidents: DataFrame) -> DataFrame:
    """``packages`` (name, version, ...) joined with the ``incidents`` (name, op, low, high, ...) that cover them."""
    return packages.join(incidents, "name").where(version_matches(F.col("op"), F.col("low"), F.col("high"), F.col("version")))


def promoted(findings: DataFrame, packages: DataFrame, incidents: DataFrame) -> DataFrame:
    """``findings`` (name, category, check_id, evidence, ...) with evidence known_incident where an incident fits.

    An incident's signature (arrays categories and check_ids) must hold both; a null one holds for all.
    """
    hit = matching(packages, incidents).select("name", "categories", "check_ids")
    fits = (F.col("h.categories").isNull() | F.array_contains("h.categories", F.col("f.category"))) & (
        F.col("h.check_ids").isNull() | F.array_contains("h.check_ids", F.col("f.check_id"))
    )
    kinds = findings.select("name", "category", "check_id").distinct()
    known = kinds.alias("f").join(hit.alias("h"), (F.col("f.name") == F.col("h.name")) & fits).select("f.*").distinct().withColumn("known", F.lit(True))
    out = findings.join(known, ["name", "category", "check_id"], "left")
    return out.withColumn("evidence", F.when(F.col("known"), "known_incident").otherwise(F.col("evidence"))).drop("known")
