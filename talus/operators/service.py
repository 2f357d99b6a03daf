"""The scan service: validation of writes, listings and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
STATUSES = ("pending", "scanning", "completed", "failed")
LEVELS = ("low", "medium", "high", "critical")


def problem() -> Column:
    """Why a scan row (status, risk_level, ratio) can't be stored; null where it can."""
    return (
        F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status")
        .when(~F.coalesce(F.col("risk_level").isin(*LEVELS), F.lit(False)), "risk_level")
        .when(~F.coalesce(F.col("ratio").between(0, 1), F.lit(False)), "ratio")
    )


def parted(scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rejected rows with their problem)."""
    marked = scans.withColumn("problem", problem())
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null")


def newest(scans: DataFrame) -> DataFrame:
    """Scans, newest first."""
    return scans.orderBy(F.desc("scanned_at"), "package")


def by_risk(reports: DataFrame) -> DataFrame:
    """Reports, riskiest first, in their own order where equal."""
    return reports.orderBy(F.desc("risk_score"), "ordinal")
