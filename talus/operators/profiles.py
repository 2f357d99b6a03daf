"""Checks on compiled-module profiles and differences between two sets of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Modules of which any import is a finding.
WILD_MODULES = (
    "ssh",
    "ssh_sftp",
    "ssh_connection",
    "ssh_client_key_api",
    "ssh_server_key_api",
    "ssh_sftpd",
    "ftp",
    "httpd",
    "tftp",
    "inet_res",
    "prim_file",
    "erl_eval",
)
# Single imports that are findings; the first two are warnings.
SINGLE_IMPORTS = (
    "inets.start",
    "inets.stop",
    "epp.scan_file",
    "epp.parse_file",
    "epp.open",
    "os.cmd",
    "erlang.open_port",
    "erlang.spawn_executable",
    "disk_log.open",
    "disk_log.log",
    "disk_log.blog",
)
WARNING_IMPORTS = ("inets.start", "inets.stop")
# Imports that make names, decode terms or call what isn't known before.
REFLECTION = (
    "Elixir.String.to_atom/1",
    "Elixir.String.to_existing_atom/1",
    "erlang.binary_to_atom/1",
    "erlang.binary_to_atom/2",
    "erlang.binary_to_existing_atom/1",
    "erlang.binary_to_existing_atom/2",
    "erlang.list_to_atom/1",
    "erlang.list_to_existing_atom/1",
    "erlang.binary_to_term/1",
    "erlang.binary_to_term/2",
    "erlang.apply/2",
    "erlang.apply/3",
    "erlang.make_fun/3",
    "Elixir.Kernel.apply/2",
    "Elixir.Kernel.apply/3",
    "erlang.fun_info/1",
    "erlang.fun_info/2",
)
MANY_KINDS, MANY_CALLS = 5, 15
SPIKE = 3
SUSPICIOUS_ATOM = r"^https?://|^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"


def _named(i: Column) -> Column:
    return F.concat(i["m"], F.lit("."), i["f"])


def _full(i: Column) -> Column:
    return F.format_string("%s.%s/%d", i["m"], i["f"], i["a"])


def dangerous(i: Column) -> Column:
    return i["m"].isin(*WILD_MODULES) | _named(i).isin(*SINGLE_IMPORTS)


def import_findings(found: DataFrame) -> DataFrame:
    """path, module, target, severity of each distinct dangerous import."""
    each = found.select("path", "module", F.explode(F.array_distinct("imports")).alias("i"))
    severity = F.when(_named(F.col("i")).isin(*WARNING_IMPORTS), "warning").otherwise("critical")
    return each.where(dangerous(F.col("i"))).select("path", "module", _full(F.col("i")).alias("target"), severity.alias("severity"))


def handles_undefined(exports: Column) -> Column:
    return F.exists(exports, lambda e: (e["f"] == "$handle_undefined_function") & (e["a"] == 2))


def _calls(found: DataFrame) -> Column:
    """The number of dispatch instructions, where the profiles hold it."""
    return F.coalesce("dispatch", F.lit(0)) if "dispatch" in found.columns else F.lit(0)


def reflection(found: DataFrame) -> DataFrame:
    """path, module, finding: undefined-function handlers, and term decoders beside dynamic calls."""
    decodes = F.exists("imports", lambda i: (i["m"] == "erlang") & (i["f"] == "binary_to_term") & i["a"].isin(1, 2))
    applies = F.exists("imports", lambda i: (i["m"] == "erlang") & (i["f"] == "apply") & i["a"].isin(2, 3)) | (_calls(found) > 0)
    kinds = F.array_compact(
        F.array(F.when(handles_undefined(F.col("exports")), "handle_undefined"), F.when(decodes & applies, "decode_and_dispatch"))
    )
    return found.select("path", "module", F.explode(kinds).alias("finding"))


def reflection_density(found: DataFrame) -> DataFrame:
    """path, module, kinds, dispatch, severity of the modules with many kinds of reflection or many dynamic calls."""
    kinds = F.size(F.array_intersect(F.transform("imports", _full), F.array(*map(F.lit, REFLECTION))))
    many, often = F.col("kinds") >= MANY_KINDS, F.col("dispatch") >= MANY_CALLS
    out = found.select("path", "module", kinds.alias("kinds"), _calls(found).alias("dispatch"))
    return out.where(many | often).withColumn("severity", F.when(many & often, "critical").otherwise("warning"))


def content_hash(found: DataFrame) -> DataFrame:
    """module, hash: a digest of what a module imports, exports and names, whatever their order."""
    parts = F.struct("module", F.array_sort("imports").alias("imports"), F.array_sort("exports").alias("exports"), F.array_sort("atoms").alias("atoms"))
    return found.select("module", F.sha2(F.to_json(parts), 256).alias("hash"))


def profile_digest(found: DataFrame) -> Column:
    """A digest of all that a profile holds but for its path: ``content_hash``'s parts, attributes, dispatch and handler."""
    attributes = F.array_sort(F.map_entries("attributes")) if "attributes" in found.columns else F.lit(None).cast("string")
    parts = F.struct(
        "module", F.array_sort("imports").alias("imports"), F.array_sort("exports").alias("exports"), F.array_sort("atoms").alias("atoms"),
        attributes.alias("attributes"), _calls(found).alias("dispatch"), handles_undefined(F.col("exports")).alias("handles_undefined"),
    )
    return F.sha2(F.to_json(parts), 256)


def prior_versions(cached: DataFrame, current: DataFrame) -> DataFrame:
    """dep, prior: the last cached version by text order that isn't the current one."""
    held = cached.join(current.select("dep", F.col("version").alias("now")), "dep").where("version <> now")
    return held.groupBy("dep").agg(F.max("version").alias("prior"))


def delta_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """module, check_id, severity, examples: what the modules of ``new`` gained against ``old``.

    A module of its own is a warning, and each of its dangerous imports is critical; of a known module one row
    names the first three. Dispatch instructions spike from SPIKE more on.
    """
    a = old.select("module", F.col("imports").alias("was"), F.col("exports").alias("old_exports"), F.col("atoms").alias("old_atoms"), _calls(old).alias("calls"), F.lit(True).alias("known"))
    both = new.select("module", "imports", "exports", "atoms", _calls(new).alias("dispatch")).join(a, "module", "left")
    imports = F.array_except("imports", F.coalesce("was", F.array().cast("array<struct<m:string,f:string,a:int>>")))
    fresh = F.array_sort(F.transform(F.filter(imports, dangerous), _full))
    atoms = F.array_sort(F.filter(F.array_except("atoms", F.coalesce("old_atoms", F.array().cast("array<string>"))), lambda x: x.rlike(SUSPICIOUS_ATOM)))
    none = F.array().cast("array<string>")
    known = F.coalesce("known", F.lit(False))
    handles = handles_undefined(F.col("exports")) & ~F.coalesce(handles_undefined(F.col("old_exports")), F.lit(False))
    found = lambda when, check, severity, examples: F.when(when, F.struct(F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), F.slice(examples, 1, 3).alias("examples")))
    kinds = F.array_compact(
        F.array(
            found(known & (F.size(fresh) > 0), "beam_delta_dangerous_import", "critical", fresh),
            found(known & handles, "beam_delta_handle_undefined", "critical", none),
            found(known & (F.col("dispatch") - F.coalesce("calls", F.lit(0)) >= SPIKE), "beam_delta_dispatch_spike", "warning", none),
            found(known & (F.size(atoms) > 0), "beam_delta_suspicious_atoms", "warning", atoms),
            found(~known, "beam_delta_module_added", "warning", none),
        )
    )
    each = F.transform(F.when(known, F.array().cast("array<string>")).otherwise(fresh), lambda x: F.struct(F.lit("beam_delta_dangerous_import").alias("check_id"), F.lit("critical").alias("severity"), F.array(x).alias("examples")))
    return both.select("module", F.inline(F.concat(kinds, each)))


def suspicious_atoms(found: DataFrame) -> DataFrame:
    hit = F.filter("atoms", lambda a: a.rlike(SUSPICIOUS_ATOM))
    return found.select("path", "module", F.explode(hit).alias("atom"))


def profile_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """module, status and the sorted new dangerous imports of two profile sets."""
    a = old.select("module", F.col("imports").alias("was"), F.col("exports").alias("old_exports"), F.col("atoms").alias("old_atoms"))
    b = new.select("module", "imports", "exports", "atoms")
    both = a.join(b, "module", "full_outer")
    same = (F.array_sort("was") == F.array_sort("imports")) & (F.array_sort("old_exports") == F.array_sort("exports")) & (F.array_sort("old_atoms") == F.array_sort("atoms"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("imports").isNull(), "removed").when(same, "same").otherwise("changed")
    none = F.array().cast("array<struct<m:string,f:string,a:int>>")
    fresh = F.filter(F.array_except(F.coalesce("imports", none), F.coalesce("was", none)), dangerous)
    return both.select("module", status.alias("status"), F.array_sort(F.transform(fresh, lambda i: F.format_string("%s.%s/%d", i["m"], i["f"], i["a"]))).alias("dangerous"))
