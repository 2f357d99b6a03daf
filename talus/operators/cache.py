"""A store of module profiles by package and version.

One Parquet folder a version, so that a version is replaced or dropped without a look at any other, and reads
of one prune to its folder. Each profile is kept with its digest, which makes the version's manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.profiles import profile_digest

KEYS = ("package", "version")
FILE_ROWS = 100_000


def save(found: DataFrame, root: str, salts: int = 1) -> None:
    """Store ``found`` (package, version and a profile's columns); versions in it replace what the store has of them.

    ``salts`` deals one version to so many tasks, for versions of very many modules.
    """
    salt = F.pmod(F.xxhash64("module"), F.lit(salts))
    rows = found.withColumn("digest", profile_digest(found)).repartition(*KEYS, salt)
    rows.write.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*KEYS).mode("overwrite").parquet(root)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """All profiles; filters on package and version select folders. Versions stay text (1.10 isn't 1.1)."""
    files, where = _file_system(spark, root)
    if not files.exists(where):
        raise FileNotFoundError(root)
    held = spark.read.option("basePath", root).parquet(root)
    kept = [f for f in held.schema.fields if f.name not in KEYS]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "package string", "version string"])
    return spark.read.schema(schema).option("basePath", root).parquet(root)


def load(spark: SparkSession, root: str, package: str, version: str) -> DataFrame:
    """The profiles of one version, none where the store hasn't it."""
    return stored(spark, root).where((F.col("package") == package) & (F.col("version") == version))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """package, version, module, digest of every stored profile."""
    return stored(spark, root).select(*KEYS, "module", "digest")


def versions(spark: SparkSession, root: str, package: str | None = None) -> DataFrame:
    """package, version of what the store holds, in text order."""
    found = stored(spark, root).select(*KEYS).distinct()
    return (found if package is None else found.where(F.col("package") == package)).orderBy(*KEYS)


def drop(spark: SparkSession, root: str, package: str, version: str) -> bool:
    """Remove one version's folder; whether there was one. No other file is read or written."""
    plain = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    files, where = _file_system(spark, f"{root}/package={plain(package)}/version={plain(version)}")
    return files.delete(where, True)


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
