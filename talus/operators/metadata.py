"""Registry metadata: penalties, warnings and the pre-install verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def penalty(meta: DataFrame) -> Column:
    """The metadata part of a risk score over columns known, source, downloads, days, owners, description, depth.

    ``source`` is hex, git or path, ``days`` the age of the newest release; packages that the registry
    doesn't know (``known`` false) have none.
    """
    total = (
        F.when(F.col("source").isin("git", "path"), 10).otherwise(0)
        + F.when(F.col("downloads") < 100, 20).when(F.col("downloads") < 1000, 10).otherwise(0)
        + F.when(F.col("days") < 7, 15).otherwise(0)
        + F.when(F.col("owners") == 1, 5).otherwise(0)
        + F.when(F.coalesce("description", F.lit("")) == "", 5).otherwise(0)
        + F.when(F.col("depth") >= 5, 10).when(F.col("depth") >= 3, 5).otherwise(0)
    )
    return F.when(F.col("known"), total).otherwise(0).cast("long")


def has_warnings() -> Column:
    """Few downloads, a single owner, a retired or a very new release."""
    return F.coalesce(F.col("downloads") < 1000, F.lit(False)) | F.coalesce(F.col("owners") == 1, F.lit(False)) | F.coalesce(F.col("retired"), F.lit(False)) | F.coalesce(F.col("days") < 7, F.lit(False))
