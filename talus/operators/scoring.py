"""Findings of the event table and the package scores built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.scoring import finding_score, popularity, risk_level, severity_base
from talus.session import table


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per event: a package is a user's day, a file is one of its hours."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("dep"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd-HH")).alias("file_path"),
        F.col("event_id"),
        F.col("user_id"),
        F.col("ts"),
        F.col("event_type").alias("category"),
        F.when(F.col("value") >= 40, "critical").when(F.col("value") >= 15, "warning").otherwise("info").alias("severity"),
        (F.col("event_id") % 3 == 0).alias("compile_time"),
        (F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)) % 5).alias("evidence"),
    )


def scored(found: DataFrame) -> DataFrame:
    return found.withColumn(
        "score", finding_score(severity_base(F.col("severity"), F.col("compile_time")), F.col("evidence"))
    )


def package_scores(found: DataFrame, extra: Column | None = None, downloads: Column | None = None) -> DataFrame:
    """Bucket by (file, category): best score plus one per further finding; sum, damp, cap at 100.

    Both levels aggregate before the shuffle; the second reuses no more than one row a bucket.
    """
    buckets = (
        scored(found).groupBy("dep", "file_path", "category").agg((F.max("score") + F.count("*") - 1).alias("bucket"), F.count("*").alias("n"))
    )
    raw = buckets.groupBy("dep").agg(F.sum("bucket").alias("raw"), F.sum("n").alias("finding_count"))
    total = F.col("raw") + (extra if extra is not None else F.lit(0))
    if downloads is not None:
        total = popularity(total, downloads)
    score = F.least(F.lit(100), total).cast("long")
    return raw.select("dep", "finding_count", score.alias("risk_score"), risk_level(score).alias("risk_level"))
