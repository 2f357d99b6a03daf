"""Project files as tables: lock files, declared dependencies and capabilities, sources.

Parsing is one small helper a file inside Spark's own scan and partitioning. Every reader has two
outputs in one frame: rows, and for a file that can't be read one row that holds only the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from talus.sources import terms
from talus.sources.terms import Atom, Unread, balanced, declared_capabilities, dependency_names, tokens

CAPABILITIES_KEY = "capabilities"


def _text(value: object) -> str | None:
    return value if isinstance(value, str) and not isinstance(value, Atom) else None


def lock_entry(name: str, value: object) -> tuple:
    """(name, source, version, hash, url) of an entry: hex of eight or seven parts, git of four; others only have a name."""
    if isinstance(value, tuple) and value and value[0] == "hex" and isinstance(value[0], Atom) and len(value) in (7, 8):
        return name, "hex", _text(value[2]), _text(value[7] if len(value) == 8 else value[3]), None
    if isinstance(value, tuple) and len(value) == 4 and value[0] == "git" and isinstance(value[0], Atom):
        return name, "git", _text(value[2]), _text(value[2]), _text(value[1])
    return name, "hex", None, None, None


@udtf(returnType="name string, source string, version string, hash string, url string, reason string")
class LockEntries:
    def eval(self, content: str):
        try:
            value = terms.literal(content or "")
            if not (isinstance(value, tuple) and len(value) == 2 and value[0] == "map" and isinstance(value[1], list)):
                raise Unread("no map literal")
            rows = [(*lock_entry(str(k), v), None) for k, v in (x for x in value[1] if isinstance(x, tuple) and len(x) == 2) if isinstance(k, Atom)]
        except (Unread, RecursionError) as e:
            rows = [(None, None, None, None, None, str(e) or type(e).__name__)]
        yield from rows


@udtf(returnType="name string, reason string")
class DeclaredNames:
    def eval(self, content: str):
        try:
            found = tokens(content or "")
            balanced(found)
            rows = [(name, None) for name in dependency_names(found)]
        except (Unread, RecursionError) as e:
            rows = [(None, str(e) or type(e).__name__)]
        yield from rows


@udtf(returnType="declared array<string>, reason string")
class Capabilities:
    def eval(self, content: str, key: str):
        try:
            found = tokens(content or "")
            balanced(found)
            yield declared_capabilities(found, key), None
        except (Unread, RecursionError) as e:
            yield None, str(e) or type(e).__name__


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, content of the text files below ``path`` whose name matches ``glob``."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """dep, path, content of every package's manifest and of the sources below its lib folder; ``path`` holds a folder a package."""
    found = files(spark, path, "*.ex*")
    root = F.regexp_extract("path", r"^(.*?/deps/|.*/)([^/]+)/(?:lib/.*|mix\.exs)$", 2)
    return found.where(r"path rlike '/lib/.*[.]exs?$|/mix[.]exs$'").select(root.alias("dep"), "path", "content")


def _read(found: DataFrame, reader) -> DataFrame:
    return found.lateralJoin(reader(F.col("content").outer())).drop("content")


def read_locks(found: DataFrame) -> DataFrame:
    """``found`` (path and other columns, content) with an entry a row, or the reason why a file has none."""
    return _read(found, LockEntries)


def lock_entries(found: DataFrame) -> DataFrame:
    return read_locks(found.select("path", "content")).where("reason is null").drop("reason")


def read_manifests(found: DataFrame) -> DataFrame:
    """``found`` with the name of a declared dependency a row, or the reason why a file has none."""
    return _read(found, DeclaredNames)


def declared_names(found: DataFrame) -> DataFrame:
    return read_manifests(found.select("path", "content")).where("reason is null").drop("reason")


def read_capabilities(found: DataFrame, key: str = CAPABILITIES_KEY) -> DataFrame:
    """``found`` with the capabilities declared under ``key`` (null: undeclared), and the reason for a file that can't be read."""
    return found.lateralJoin(Capabilities(F.col("content").outer(), F.lit(key))).drop("content")
