"""Native code in packages: shipped artifacts, source folders, build files, compilers, loaders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
ARTIFACT = r"^priv/.*\.(so|dylib|dll)$"
SOURCE_DIRS = ("c_src", "native", "rust", "src_c")
BUILD_FILES = ("Makefile", "makefile", "GNUmakefile", "CMakeLists.txt", "build.zig", "Cargo.toml")
COMPILERS = (":elixir_make", ":rustler")


def native_findings(files: DataFrame) -> DataFrame:
    """dep, check_id, target, severity, compile_time of ``files`` (dep, path below the package, content)."""
    path = F.col("path")
    top = F.substring_index("path", "/", 1)
    uses = F.exists(F.array(*map(F.lit, COMPILERS)), lambda c: F.contains(F.coalesce("content", F.lit("")), c))
    found = lambda check, target, severity, built: F.struct(F.lit(check).alias("check_id"), target.alias("target"), F.lit(severity).alias("severity"), F.lit(built).alias("compile_time"))
    kinds = F.array_compact(
        F.array(
            F.when(path.rlike(ARTIFACT), found("native_code_artifact", path, "critical", False)),
            F.when(top.isin(*SOURCE_DIRS) & path.contains("/"), found("native_code_source", top, "warning", True)),
            F.when(path.isin(*BUILD_FILES), found("native_code_build_file", path, "warning", True)),
            F.when((path == "mix.exs") & uses, found("native_code_compiler", path, "warning", True)),
        )
    )
    return files.select("dep", F.inline(kinds)).distinct()


def loaders(profiles: DataFrame) -> DataFrame:
    """The compiled modules that load native code themselves."""
    loads = F.exists("imports", lambda i: (i["m"] == "erlang") & (i["f"] == "load_nif") & (i["a"] == 2))
    return profiles.where(loads).select("path", "module", F.lit("native_code_load_nif").alias("check_id"), F.lit("critical").alias("severity"))
