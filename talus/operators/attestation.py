"""Trust in what is installed: signed manifests against trusted keys, and their modules against local profiles.

Signatures are checked elsewhere; their verdicts are input rows (package, version, key, valid).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What an install without a manifest counts as, by policy.
UNSIGNED = {"advisory": None, "require": "warning", "strict": "critical"}
KEYS = ["package", "version"]


def trusted_keys(*scopes: DataFrame) -> DataFrame:
    """The keys (key) of all scopes, a project's and the user's."""
    out = scopes[0].select("key")
    for scope in scopes[1:]:
        out = out.unionByName(scope.select("key"))
    return out.distinct()


def findings(installs: DataFrame, declared: DataFrame, verdicts: DataFrame, keys: DataFrame, local: DataFrame, policy: str = "advisory") -> DataFrame:
    """package, version, check_id, severity, module, status of ``installs`` (package, version).

    ``declared`` holds package, version and an array module_hashes (module, content_hash) a manifest, ``local`` package, module, digest.
    No manifest: by policy. No valid verdict of a trusted key: untrusted. Else each declared module that
    is missing or differs. Installs without a version aren't judged.
    """
    held = installs.where("version is not null").select(*KEYS).distinct().join(declared.select(*KEYS, "module_hashes"), KEYS, "left")
    valid = verdicts.where("valid").join(keys, "key", "left_semi").select(*KEYS).distinct().withColumn("trusted", F.lit(True))
    held = held.join(valid, KEYS, "left")
    row = lambda check, severity, module, status: [*KEYS, F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), module.alias("module"), status.alias("status")]
    none = F.lit(None).cast("string")
    out = held.where("module_hashes is not null and trusted is null").select(*row("attestation_untrusted", "critical", none, none))
    modules = held.where("trusted").select(*KEYS, F.inline("module_hashes"))
    found = local.select("package", "module", "digest").distinct()
    compared = modules.join(found, ["package", "module"], "left").where("digest is null or digest <> content_hash")
    status = F.when(F.col("digest").isNull(), "missing").otherwise("mismatch")
    out = out.union(compared.select(*row("attestation_hash_mismatch", "critical", F.col("module"), status)))
    if UNSIGNED[policy]:
        out = out.union(held.where("module_hashes is null").select(*row("attestation_unsigned", UNSIGNED[policy], none, none)))
    return out
