"""Suppression, correlation and summaries of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.scoring import scored


def suppressed(found: DataFrame, allowed: DataFrame, keep: bool = False) -> DataFrame:
    """Findings whose (dep, category) is not in ``allowed``; with ``keep`` those whose is."""
    return found.join(allowed.select("dep", "category").distinct(), ["dep", "category"], "left_semi" if keep else "left_anti")


def escalated(found: DataFrame, target: str, witness: str) -> DataFrame:
    """Findings of ``target`` become critical and corroborated where their dep also has ``witness``."""
    seen = F.max(F.when(F.col("category") == witness, 1).otherwise(0)).over(Window.partitionBy("dep")) == 1
    hit = (F.col("category") == target) & seen
    return found.withColumn("hit", hit).select(
        *[c for c in found.columns if c not in ("severity", "evidence")],
        F.when(F.col("hit"), "critical").otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("hit"), F.greatest(F.lit(1), "evidence")).otherwise(F.col("evidence")).alias("evidence"),
    )


def paired(found: DataFrame, one: str, other: str) -> DataFrame:
    """Both categories become critical and corroborated in deps that have both."""
    here = Window.partitionBy("dep")
    has = lambda c: F.max(F.when(F.col("category") == c, 1).otherwise(0)).over(here)
    hit = F.col("category").isin(one, other) & (has(one) + has(other) == 2)
    return found.withColumn("hit", hit).select(
        *[c for c in found.columns if c not in ("severity", "evidence")],
        F.when(F.col("hit"), "critical").otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("hit"), F.greatest(F.lit(1), "evidence")).otherwise(F.col("evidence")).alias("evidence"),
    )


def downgraded(found: DataFrame, path: str) -> DataFrame:
    """Run-time warnings in files that match ``path`` become info."""
    hit = F.col("file_path").rlike(path) & ~F.col("compile_time") & (F.col("severity") == "warning")
    return found.withColumn("severity", F.when(hit, "info").otherwise(F.col("severity")))


def summary(scores: DataFrame) -> DataFrame:
    """One row: deps, findings, deps by level, the highest score and its first dep."""
    levels = [F.count_if(F.col("risk_level") == x).alias(f"n_{x}") for x in ("low", "medium", "high", "critical")]
    return scores.agg(
        F.count("*").alias("n_deps"),
        F.coalesce(F.sum("finding_count"), F.lit(0)).alias("n_findings"),
        *levels,
        F.coalesce(F.max("risk_score"), F.lit(0)).cast("long").alias("max_score"),
        F.min_by("dep", F.struct(-F.col("risk_score"), F.col("dep"))).alias("max_dep"),
    )


def gate(scores: DataFrame, threshold: int = 50) -> DataFrame:
    top = F.coalesce(F.max("risk_score"), F.lit(0)).cast("long")
    return scores.agg(top.alias("max_score"), (top >= threshold).alias("failed"))


def consensus(votes: DataFrame) -> DataFrame:
    """Per package the most frequent hash (null counts), its share and the votes; ties go to the
    smaller hash, null last."""
    counts = votes.groupBy("package", "findings_hash").agg(F.count("*").alias("n"))
    first = F.struct(-F.col("n"), F.col("findings_hash").isNull(), F.col("findings_hash"))
    return counts.groupBy("package").agg(
        F.min_by("findings_hash", first).alias("findings_hash"),
        (F.max("n") / F.sum("n")).alias("agreement"),
        F.sum("n").alias("total"),
    )


def evidence_rollup(found: DataFrame) -> DataFrame:
    return scored(found).groupBy("evidence").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("total"))
