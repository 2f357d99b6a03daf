"""Scoring expressions: severity bases, evidence weights, risk levels, penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rounded finding score for (base, evidence ordinal). The evidence ladder is
# pattern_match, corroborated, sandbox_observed, llm_confirmed, known_incident.
FINDING_SCORES = {
    40: (40, 52, 60, 68, 100),
    20: (20, 26, 30, 34, 50),
    15: (15, 20, 23, 26, 38),
    5: (5, 7, 8, 9, 13),
    1: (1, 1, 2, 2, 3),
}
EVIDENCE = ("pattern_match", "corroborated", "sandbox_observed", "llm_confirmed", "known_incident")
EVIDENCE_WEIGHTS = (1.0, 1.3, 1.5, 1.7, 2.5)
SEVERITIES = ("info", "warning", "critical")


def severity_base(severity: Column, compile_time: Column) -> Column:
    return (
        F.when((severity == "critical") & compile_time, 40)
        .when(severity == "critical", 15)
        .when((severity == "warning") & compile_time, 20)
        .when(severity == "warning", 5)
        .otherwise(1)
    )


def finding_score(base: Column, evidence: Column) -> Column:
    """Exact integer table lookup; an evidence ordinal outside the ladder counts as 0."""
    rung = F.when(evidence.between(0, 4), evidence).otherwise(0) + 1
    out = F.lit(None).cast("int")
    for value, scores in FINDING_SCORES.items():
        out = F.when(base == value, F.element_at(F.array(*map(F.lit, scores)), rung.cast("int"))).otherwise(out)
    return out


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 50, "high").when(score >= 20, "medium").otherwise("low")


def popularity(score: Column, downloads: Column) -> Column:
    """Score damped for widely used packages; a null download count leaves it as it is."""
    damped = F.when(downloads > 10_000_000, score * 0.3).when(downloads > 1_000_000, score * 0.5).otherwise(score * 1.0)
    return F.floor(damped + 0.5).cast("long")
