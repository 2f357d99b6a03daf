"""Registry answers and stored scan histories: nested JSON of any shape, read part by part as variants.

A part of another type than it should have counts as missing; a text that is no JSON at all gives a row with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKBACK = 10
#: A moment with its offset; without one it isn't a moment.
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
# The categories of findings.
CATEGORIES = (
    "system_exec", "code_eval", "network_access", "file_access", "env_access", "obfuscation", "shady_links", "compiler_hooks",
    "dos_atom_exhaustion", "metadata", "phantom_package", "version_transition", "temporal_anomaly", "native_code", "bytecode_imports",
    "reflection", "bytecode_version_delta", "capability_mismatch", "attestation_mismatch", "sandboxed_compile_behavior",
)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _text(doc: Column, path: str) -> Column:
    value = F.try_variant_get(doc, path, "variant")
    return F.when(_is(value, "STRING"), F.try_variant_get(doc, path, "string"))


def _count(doc: Column, path: str) -> Column:
    value = F.try_variant_get(doc, path, "variant")
    return F.coalesce(F.when(_is(value, "BIGINT"), F.try_variant_get(doc, path, "bigint")), F.lit(0).cast("long"))


def _list(doc: Column, path: str) -> Column:
    """The parts of a list; null for what is none."""
    return F.try_variant_get(doc, path, "array<variant>")


def moment(text: Column) -> Column:
    return F.when(text.rlike(MOMENT), F.try_to_timestamp(text))


def previous(versions: Column, current: Column, back: int = 1, clamp: bool = False) -> Column:
    """The version so many places behind ``current`` in a newest-first list; with ``clamp`` the oldest one beyond its end."""
    at = F.array_position(versions, current).cast("int")
    found = F.get(versions, at - 1 + back)
    return F.when(at > 0, F.coalesce(found, F.element_at(versions, -1)) if clamp else found)


def registry(answers: DataFrame) -> DataFrame:
    """``answers`` (content, and current, the version in use or null, where it has one; other columns stay) with
    downloads, latest_version, released_at, previous_version, lookback_version, owners, description, retired and reason."""
    current = F.col("current") if "current" in answers.columns else F.lit(None).cast("string")
    held = answers.withColumn("doc", F.try_parse_json("content"))
    releases = F.coalesce(_list(F.col("doc"), "$.releases"), F.array().cast("array<variant>"))
    held = held.withColumns({"sound": _is(F.col("doc"), "OBJECT"), "releases": releases})
    newest = F.get("releases", F.lit(0))
    versions = F.array_compact(F.transform("releases", lambda r: _text(r, "$.version")))
    held = held.withColumns({"versions": versions, "latest_version": _text(newest, "$.version")})
    now = F.coalesce(current, "latest_version")
    parts = {
        "downloads": F.when(F.col("sound"), _count(F.col("doc"), "$.downloads.all")),
        "released_at": moment(_text(newest, "$.inserted_at")),
        "previous_version": previous(F.col("versions"), now),
        "lookback_version": previous(F.col("versions"), now, LOOKBACK, True),
        "owners": F.size(_list(F.col("doc"), "$.owners")).cast("int"),
        "description": _text(F.col("doc"), "$.meta.description"),
        "retired": F.when(F.col("sound"), _is(F.try_variant_get(newest, "$.retirement", "variant"), "OBJECT")),
        "reason": F.when(~F.col("sound"), "no JSON object"),
    }
    owners = F.when(_list(F.col("doc"), "$.owners").isNotNull(), parts.pop("owners"))
    return held.withColumns(parts | {"owners": owners}).drop("doc", "content", "releases", "versions", "sound")


def history(stored: DataFrame, now: Column | None = None) -> DataFrame:
    """The records of stored histories (content, a JSON list; other columns stay): place, version, scan_date, finding_count,
    categories, risk_score. What is no list has none.

    A record with a category that isn't known has no categories and, as one without a moment, the date ``now``.
    """
    moment_now = F.current_timestamp() if now is None else now
    each = stored.withColumn("records", F.try_variant_get(F.try_parse_json("content"), "$", "array<variant>"))
    rows = each.select("*", F.posexplode("records").alias("place", "r")).where(_is(F.col("r"), "OBJECT"))
    names = F.transform(F.coalesce(_list(F.col("r"), "$.categories"), F.array().cast("array<variant>")), lambda c: _text(c, "$"))
    known = F.forall(names, lambda c: F.coalesce(c.isin(*CATEGORIES), F.lit(False)))
    found = rows.withColumns({"names": names, "known": known})
    return found.withColumns(
        {
            "version": _text(F.col("r"), "$.version"),
            "scan_date": F.when(F.col("known"), F.coalesce(moment(_text(F.col("r"), "$.scan_date")), moment_now)).otherwise(moment_now),
            "finding_count": _count(F.col("r"), "$.finding_count"),
            "categories": F.when(F.col("known"), F.col("names")).otherwise(F.array().cast("array<string>")),
            "risk_score": _count(F.col("r"), "$.risk_score"),
        }
    ).drop("content", "records", "r", "names", "known")
