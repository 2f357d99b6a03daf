"""Version expressions: semantic order keys, matching of version conditions, shortening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?$"


def version_key(version: Column) -> Column:
    """A struct that orders as semantic versions do; null for what isn't one.

    A release comes after its pre-releases; numeric identifiers come before others and compare as numbers, of
    any length: by their digits' count, then by the digits.
    """
    part = lambda i: F.regexp_extract(version, SEMVER, i)
    number = lambda i: F.struct(F.length(part(i)).alias("length"), part(i).alias("digits"))
    ordered = lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(F.length(x).cast("string"), 9, "0"), x)).otherwise(F.concat(F.lit("1"), x))
    pre = F.array_join(F.transform(F.split(part(4), r"\."), ordered), "\u0001")
    return F.when(version.rlike(SEMVER), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (part(4) == "").alias("released"), pre.alias("pre")))


def version_matches(op: Column, low: Column, high: Column, version: Column) -> Column:
    """Whether a version meets any, eq, lt, lte, gte (against ``low``) or range (both ends inside)."""
    key, lo, hi = version_key(version), version_key(low), version_key(high)
    holds = (
        F.when(op == "any", True)
        .when(op == "eq", version == low)
        .when(op == "lt", key < lo)
        .when(op == "lte", key <= lo)
        .when(op == "gte", key >= lo)
        .when(op == "range", (key >= lo) & (key <= hi))
    )
    return F.coalesce(holds, F.lit(False))


def minor_of(version: Column) -> Column:
    """Major and minor of a version; one without a dot as it is."""
    return F.when(version.contains("."), F.substring_index(version, ".", 2)).otherwise(version)
