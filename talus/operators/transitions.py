"""Findings from file sets of two versions: the step from the release before and a longer look back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unexpected_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """dep, n: how many new paths outside tests each package of ``new`` (dep, path) has against ``old``."""
    fresh = new.select("dep", "path").distinct().join(old.select("dep", "path").distinct(), ["dep", "path"], "left_anti")
    return fresh.where(~F.contains("path", F.lit("test"))).groupBy("dep").agg(F.count("*").alias("n"))


def transition_findings(steps: DataFrame, signals: DataFrame) -> DataFrame:
    """dep, check_id, severity, description for ``signals`` (dep, against, signal) of ``steps`` (dep, current, previous, lookback).

    ``against`` is previous or lookback. A look back counts only where it differs from both other versions,
    a step only where its versions differ; a shift of profile in a step is critical, all else a warning.
    """
    own = F.col("against") == "previous"
    step = own & F.col("previous").isNotNull() & (F.col("previous") != F.col("current"))
    back = (F.col("against") == "lookback") & F.col("lookback").isNotNull() & (F.col("lookback") != F.col("current")) & ~F.col("lookback").eqNullSafe(F.col("previous"))
    return signals.join(steps, "dep").where(step | back).select(
        "dep",
        F.when(own, "version_transition").otherwise("version_lookback").alias("check_id"),
        F.when(own & (F.col("signal") == "profile_shift"), "critical").otherwise("warning").alias("severity"),
        F.concat_ws(" ", F.when(own, F.col("previous")).otherwise(F.col("lookback")), F.lit("to"), "current", F.concat(F.lit("("), F.col("signal"), F.lit(")"))).alias("description"),
    )
