"""Review verdicts: parsing judgments and applying them to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINDING = r"(?i)FINDING\s+#([0-9]+):\s*(CONFIRMED|REFUTED|UNCERTAIN)"
OVERALL = r"(?i)OVERALL:\s*(MALICIOUS|BENIGN|UNCERTAIN)"


def verdicts(reviews: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, verdict of the finding lines in review texts; of several lines on one finding the last holds.

    A number too long for a finding's place has a null position, which no finding has.
    """
    lines = reviews.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    lines = lines.where(F.col("line").rlike(FINDING))
    read = lines.select(key, "at", F.regexp_extract("line", FINDING, 1).try_cast("long").alias("position"), F.lower(F.regexp_extract("line", FINDING, 2)).alias("verdict"))
    return read.groupBy(key, "position").agg(F.max_by("verdict", "at").alias("verdict"))


def overall(reviews: DataFrame, key: str, text: str) -> DataFrame:
    """key, overall: the first overall verdict of each review, uncertain by default."""
    found = F.regexp_extract(text, OVERALL, 1)
    return reviews.select(key, F.when(found == "", "uncertain").otherwise(F.lower(found)).alias("overall"))


def judged(findings: DataFrame, given: DataFrame, key: str, order: list) -> DataFrame:
    """``findings`` with evidence (llm_confirmed where confirmed) and severity (one tier down where refuted).

    Findings are numbered from 1 by ``order`` within their key; those without a verdict stay.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    out = findings.withColumn("position", place).join(given, [key, "position"], "left")
    lower = F.when(F.col("severity") == "critical", "warning").otherwise("info")
    return out.withColumn("evidence", F.when(F.col("verdict") == "confirmed", "llm_confirmed").otherwise(F.col("evidence"))).withColumn(
        "severity", F.when(F.col("verdict") == "refuted", lower).otherwise(F.col("severity"))
    )


def worth_review(reports: DataFrame, least: int = 30) -> DataFrame:
    """The reports (finding_count, risk_score) that go to adversarial review."""
    return reports.where((F.col("finding_count") > 0) & (F.col("risk_score") >= least))
