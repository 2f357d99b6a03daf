"""Scan history: streaks, trust, anomalies, versions and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def streaks(scans: DataFrame, digits: int = 2) -> DataFrame:
    """package, total, clean_streak, trust: trailing scans without findings and what they earn."""
    newest = Window.partitionBy("package").orderBy(F.desc("scan_date"), F.desc("version")).rowsBetween(Window.unboundedPreceding, 0)
    dirty = F.sum(F.when(F.col("finding_count") > 0, 1).otherwise(0)).over(newest)
    out = scans.withColumn("dirty", dirty).groupBy("package").agg(
        F.count("*").alias("total"), F.count_if(F.col("dirty") == 0).alias("clean_streak")
    )
    trust = 0.6 * F.col("clean_streak") / F.col("total") + 0.4 * F.least(F.lit(1.0), F.col("total") / 20)
    return out.withColumn("trust", F.round(trust, digits))


def anomalies(scans: DataFrame) -> DataFrame:
    """package, version, anomaly, severity of each scan that has an earlier one.

    Only categories that no earlier scan of the package had are new: a category's first scan is found
    by aggregation, so no package's history is gathered in arrays.
    """
    order = Window.partitionBy("package").orderBy("scan_date", "version")
    numbered = scans.withColumn("place", F.row_number().over(order))
    each = numbered.select("package", "place", F.explode("categories").alias("category")).distinct()
    fresh = each.groupBy("package", "category").agg(F.min("place").alias("place")).groupBy("package", "place").agg(F.count("*").alias("fresh"))
    joined = numbered.where("place > 1").join(fresh, ["package", "place"], "left")
    n = F.col("finding_count")
    base = F.when(n >= 10, 30).when(n >= 5, 20).when(n >= 1, 10).otherwise(0)
    score = F.least(F.lit(100), base + 15 * F.coalesce("fresh", F.lit(0))).cast("long")
    out = joined.select("package", "version", score.alias("anomaly"))
    severity = F.when(F.col("anomaly") >= 30, "critical").when(F.col("anomaly") >= 15, "warning").when(F.col("anomaly") > 0, "info")
    return out.withColumn("severity", F.coalesce(severity, F.lit("none")))


def latest(records: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last record of each key: an upsert of a whole history."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return records.withColumn("turn", turn).where("turn = 1").drop("turn")


def timeline(scores: DataFrame) -> DataFrame:
    """Each package's scores in time with the change to the one before."""
    order = Window.partitionBy("package").orderBy("scan_date")
    return scores.withColumn("delta", F.col("risk_score") - F.lag("risk_score").over(order))


def versions(releases: DataFrame, steps: int = 10) -> DataFrame:
    """package, version, previous, lookback: the release before and the one ``steps`` before, which
    clamps to the oldest."""
    newest = Window.partitionBy("package").orderBy(F.desc("released"), F.desc("version"))
    whole = newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return releases.select(
        "package",
        "version",
        F.lead("version").over(newest).alias("previous"),
        F.coalesce(F.lead("version", steps).over(newest), F.last("version").over(whole)).alias("lookback"),
    )
