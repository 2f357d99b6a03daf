"""Differences between versions: files, modules and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.session import spread, written


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (added, removed, modified, same) of two (path, content) trees."""
    a = old.select("path", F.sha2("content", 256).alias("old_hash"))
    b = new.select("path", F.sha2("content", 256).alias("new_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "modified")
        .otherwise("same")
    )
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def set_delta(old: DataFrame, new: DataFrame, key: str, item: str) -> DataFrame:
    """key, added, removed: how many items of each key are new or gone, as joins of rows, not arrays."""
    a = old.select(key, item).distinct().withColumn("old", F.lit(1))
    b = new.select(key, item).distinct().withColumn("new", F.lit(1))
    both = a.join(b, [key, item], "full_outer")
    return both.groupBy(key).agg(
        F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("common")
    )


def mismatched(declared: DataFrame, local: DataFrame) -> DataFrame:
    """path, problem: declared hashes that are missing or differ locally."""
    both = declared.join(local, "path", "left")
    problem = F.when(F.col("local_hash").isNull(), "missing").when(F.col("local_hash") != F.col("declared_hash"), "mismatch")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def capability_problems(declared: DataFrame, observed: DataFrame, valid: DataFrame, key: str, rows: int = 0) -> DataFrame:
    """key, capability, problem (undeclared_use, declared_unused, unknown) of (key, capability) rows.

    Keys that declare nothing have no problems; a declared capability outside ``valid`` is unknown,
    used or not. Where ``rows``, about how many rows both sides have, are many, more tasks share them.
    """
    no, yes = F.lit(False), F.lit(True)
    marks = declared.select(key, "capability", yes.alias("said"), no.alias("used")).unionByName(observed.select(key, "capability", no.alias("said"), yes.alias("used")))
    # one aggregate meets both sides of a pair, so no task holds, sorts or joins them
    both = spread(marks, rows, key, "capability").groupBy(key, "capability").agg(F.bool_or("said").alias("said"), F.bool_or("used").alias("used"))
    # one row a key: written, so that Spark sees whether they are few enough for a broadcast
    owners = written(declared.select(F.col(key).alias("owner")).distinct().where("owner is not null"), "owners").withColumn("owns", yes)
    known = valid.select(F.col("capability").alias("name")).distinct().withColumn("known", yes)
    problem = (
        F.when(~F.col("said"), F.when(F.col("owns"), "undeclared_use"))
        .when(F.col("known").isNull(), "unknown")
        .when(~F.col("used"), "declared_unused")
    )
    held = both.join(owners, F.col(key) == F.col("owner"), "left").join(known, F.col("capability") == F.col("name"), "left")
    return held.select(key, "capability", problem.alias("problem")).where("problem is not null")
