"""A scan: package sources to facts, facts to findings by registered checks, findings to scores, in a fixed order of stages.

Sources are parsed once; the facts stand in the shared folder, and every check, a user's too, is a transform of
them. Findings have dep, path, line, check_id, category, severity, compile_time and evidence (its place on the ladder).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators import checks, correlate, hooks, incidents
from talus.operators.scoring import package_scores
from talus.session import written
from talus.sources.facts import file_facts, of_kind

FINDING = ("dep", "path", "line", "check_id", "category", "severity", "compile_time", "evidence")
# The category of each check whose name isn't its category.
CATEGORIES = {
    "eex_eval": "code_eval",
    "atom_exhaustion": "dos_atom_exhaustion",
    "dynamic_apply": "obfuscation",
    "crypto_decrypt": "obfuscation",
    "decode_eval": "obfuscation",
    "entropy": "obfuscation",
}
MIX_TASKS = r"/lib/mix/|/Elixir[.]Mix[.]Tasks[.]"


@dataclass
class Facts:
    """What the sources (dep, path, content) hold: calls, string literals, compile-time hooks."""

    calls: DataFrame
    literals: DataFrame
    hooks: DataFrame

    @classmethod
    def of(cls, sources: DataFrame) -> Facts:
        """One pass over the sources; the facts are stored, and each kind is read back by its own columns."""
        held = written(file_facts(sources), "facts")
        return cls(*(of_kind(held, fact) for fact in ("call", "literal", "hook")))


Check = Callable[[Facts], DataFrame]
CHECKS: dict[str, Check] = {}


def check(name: str) -> Callable[[Check], Check]:
    """Registers a check: a transform of facts that gives dep, path, line, check_id, severity and compile_time, and a category where it isn't ``name``'s."""

    def registered(f: Check) -> Check:
        CHECKS[name] = f
        return f

    return registered


@check("calls")
def _calls(facts: Facts) -> DataFrame:
    return checks.call_findings(facts.calls)


@check("decode_eval")
def _decode_eval(facts: Facts) -> DataFrame:
    found = checks.decode_then_eval(facts.calls)
    return found.select("dep", "path", F.col("body").alias("line"), F.lit("decode_eval").alias("check_id"), F.lit("critical").alias("severity"), F.lit(True).alias("compile_time"))


@check("entropy")
def _entropy(facts: Facts) -> DataFrame:
    found = checks.dense_literals(facts.literals)
    return found.select("dep", "path", "line", F.lit("entropy").alias("check_id"), F.lit("critical").alias("severity"), F.lit(False).alias("compile_time"))


@check("compiler_hooks")
def _hooks(facts: Facts) -> DataFrame:
    return hooks.hook_findings(facts.hooks, facts.calls)


def findings(facts: Facts, names: tuple[str, ...] | None = None) -> DataFrame:
    """The findings of the named checks, of all by default: one plan over the same facts."""
    out: DataFrame | None = None
    category = F.col("check_id")
    for name, of in CATEGORIES.items():
        category = F.when(F.col("check_id") == name, of).otherwise(category)
    for name in names or tuple(CHECKS):
        found = CHECKS[name](facts)
        found = found if "category" in found.columns else found.withColumn("category", category)
        found = found.withColumn("evidence", F.col("evidence") if "evidence" in found.columns else F.lit(0)).select(*FINDING)
        out = found if out is None else out.unionByName(found)
    return out


def correlated(found: DataFrame) -> DataFrame:
    """Dynamic calls beside network access, and dense literals beside decryption, become critical and corroborated;
    run-time warnings of build tasks become info. What a package has is one aggregated row, joined back."""
    has = lambda when, name: F.max(F.when(when, 1).otherwise(0)).alias(name)
    flags = found.groupBy("dep").agg(
        has(F.col("category") == "network_access", "network"), has(F.col("check_id") == "entropy", "entropy"), has(F.col("check_id") == "crypto_decrypt", "crypto")
    )
    hit = (F.col("check_id") == "dynamic_apply") & (F.col("network") == 1)
    hit |= F.col("check_id").isin("entropy", "crypto_decrypt") & (F.col("entropy") + F.col("crypto") == 2)
    risen = found.join(flags, "dep").withColumn("hit", hit)
    risen = risen.withColumns({"severity": F.when(F.col("hit"), "critical").otherwise(F.col("severity")), "evidence": F.when(F.col("hit"), F.greatest(F.lit(1), "evidence")).otherwise(F.col("evidence"))})
    return correlate.downgraded(risen.withColumn("file_path", F.col("path")), MIX_TASKS).select(*FINDING)


def scanned(found: DataFrame, allowed: DataFrame, more: DataFrame | None = None, packages: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The findings that count, in a scan's order of stages: correlation before allowances, then ``more`` (of version and
    history checks, which no allowance silences), then promotion by ``known`` incidents of ``packages`` (name, version)."""
    out = correlate.suppressed(correlated(found), allowed).select(*FINDING)
    if more is not None:
        out = out.unionByName(more.select(*FINDING))
    if known is not None and packages is not None:
        rungs = F.array(*map(F.lit, ("pattern_match", "corroborated", "sandbox_observed", "llm_confirmed", "known_incident")))
        named = out.withColumn("name", F.col("dep")).withColumn("evidence", F.element_at(rungs, F.col("evidence") + 1))
        out = incidents.promoted(named, packages, known).withColumn("evidence", (F.array_position(rungs, F.col("evidence")) - 1).cast("int")).select(*FINDING)
    return out


def scores(found: DataFrame) -> DataFrame:
    """dep, finding_count, risk_score, risk_level of each package with findings."""
    return package_scores(found.withColumnRenamed("path", "file_path"))
