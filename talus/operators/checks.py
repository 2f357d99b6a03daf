"""Rule checks: call facts joined with a pattern table, and rules on their arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.text import byte_entropy

# Calls that are findings. Columns: check, module, functions (* for all), severity at
# run time, severity at compile time.
PATTERNS = (
    ("system_exec", "System", "cmd shell find_executable", "critical", "critical"),
    ("system_exec", "os", "cmd", "critical", "critical"),
    ("system_exec", "Port", "open", "critical", "critical"),
    ("code_eval", "Code", "eval_string eval_quoted eval_file compile_string compile_quoted", "critical", "critical"),
    ("code_eval", "erlang", "binary_to_term", "critical", "critical"),
    ("code_eval", "Module", "create", "critical", "critical"),
    ("code_eval", "compile", "file forms file_binary noenv_file noenv_forms", "critical", "critical"),
    ("eex_eval", "EEx", "eval_string eval_file", "critical", "critical"),
    ("eex_eval", "EEx", "compile_string compile_file", "warning", "critical"),
    ("network_access", "httpc", "request", "warning", "critical"),
    ("network_access", "gen_tcp", "connect listen accept controlling_process", "warning", "critical"),
    ("network_access", "ssl", "connect listen accept", "warning", "critical"),
    ("network_access", "gen_udp", "open connect send recv", "warning", "critical"),
    ("network_access", "gen_sctp", "open connect listen send recv", "warning", "critical"),
    ("network_access", "Req", "*", "warning", "critical"),
    ("network_access", "HTTPoison", "*", "warning", "critical"),
    ("network_access", "Finch", "*", "warning", "critical"),
    ("network_access", "Mint.HTTP", "*", "warning", "critical"),
    ("network_access", "socket", "*", "warning", "critical"),
    ("atom_exhaustion", "String", "to_atom", "warning", "critical"),
    ("atom_exhaustion", "List", "to_atom", "warning", "critical"),
    ("atom_exhaustion", "erlang", "binary_to_atom list_to_atom", "warning", "critical"),
    ("crypto_decrypt", "crypto", "block_decrypt crypto_one_time stream_decrypt crypto_one_time_aead block_decrypt_init", "warning", "warning"),
    ("file_access", "File", "read! write! stream! rm rm_rf read write cp cp_r open open!", "warning", "info"),
    ("file_access", "file", "read_file read_file_info consult open read pread script path_consult path_script list_dir read_link write_file delete del_dir rename make_link make_symlink", "warning", "info"),
    ("dynamic_apply", "Kernel", "apply_dynamic", "warning", "warning"),
    ("env_access", "System", "get_env fetch_env fetch_env!", "warning", "warning"),
)
SENSITIVE_PATHS = ("~/.ssh", "~/.aws", "~/.kube", "~/.gnupg", "~/.config", "/etc/passwd", "/etc/shadow")
SENSITIVE_NAMES = ("SECRET", "KEY", "TOKEN", "PASSWORD", "CREDENTIAL", "AWS_", "GITHUB_", "DATABASE_URL")


def pattern_table(spark: SparkSession) -> DataFrame:
    rows = [(c, m, f, run, built) for c, m, names, run, built in PATTERNS for f in names.split()]
    return spark.createDataFrame(rows, "check_id string, module string, func string, at_run string, at_build string")


def _any(literals: Column, parts: tuple[str, ...], upper: bool = False) -> Column:
    text = (lambda x: F.upper(x)) if upper else (lambda x: x)
    hit = lambda x: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text(x), p))
    return F.exists(literals, hit)


def _keys(found: DataFrame) -> list[str]:
    """A file is named by its package, where the frame has it, and its path."""
    return [c for c in ("dep", "path") if c in found.columns]


def call_findings(facts: DataFrame) -> DataFrame:
    """path, line, check_id, severity, compile_time: facts joined with the pattern table, exact and wildcard."""
    spark = facts.sparkSession
    # the table above, of fixed size
    dim = F.broadcast(pattern_table(spark))
    exact = facts.join(dim, ["module", "func"])
    wild = facts.join(dim.where("func = '*'").drop("func"), "module")
    found = exact.unionByName(wild)
    plain = F.when(F.col("compile_time"), F.col("at_build")).otherwise(F.col("at_run"))
    severity = (
        F.when((F.col("check_id") == "file_access") & _any(F.col("literals"), SENSITIVE_PATHS), "critical")
        .when((F.col("check_id") == "env_access") & _any(F.col("literals"), SENSITIVE_NAMES, True), "critical")
        .when((F.col("check_id") == "env_access") & (F.col("func") == "get_env") & F.col("empty_call"), "critical")
        .otherwise(plain)
    )
    return found.select(*_keys(found), "line", "check_id", severity.alias("severity"), "compile_time")


def decode_then_eval(facts: DataFrame) -> DataFrame:
    """path, body of the definitions that both decode base 64 and evaluate a string."""
    has = lambda m, f: F.max(F.when((F.col("module") == m) & (F.col("func") == f), 1).otherwise(0)) == 1
    either = facts.where("module = 'Base' and func = 'decode64' or module = 'Code' and func = 'eval_string'")
    both = either.groupBy(*_keys(facts), "body").agg(has("Base", "decode64").alias("decodes"), has("Code", "eval_string").alias("evaluates"))
    return both.where("decodes and evaluates").select(*_keys(facts), "body")


def dense_literals(texts: DataFrame, least: int = 40, bits: float = 5.5, spaces: float = 0.1) -> DataFrame:
    """path, line, entropy of string literals (path, line, text) that look encoded."""
    blank = F.regexp_count("text", F.lit(" ")) / F.char_length("text")
    likely = texts.where((F.octet_length("text") > least) & (blank <= spaces) & ~F.startswith("text", F.lit("data:")))
    keyed = likely.select(F.struct(*_keys(texts), "line", F.xxhash64("text").alias("at")).alias("key"), "text").dropDuplicates(["key"])
    return byte_entropy(keyed, "key", "text").where(F.col("entropy") > bits).select(*[f"key.{c}" for c in _keys(texts)], "key.line", "entropy")


def by_context(context: Column, path: Column) -> Column:
    """Whether code runs at compile time by the blocks around it (module_body, def, defmacro, module_attribute, quote): in a
    manifest, an attribute or a macro, or in a module's body outside of functions; not elsewhere."""
    has = lambda c: F.array_contains(context, c)
    inside = has("module_attribute") | has("defmacro") | has("module_body") & ~has("def")
    return F.coalesce(F.endswith(path, F.lit("mix.exs")), F.lit(False)) | inside


def raised(found: DataFrame) -> DataFrame:
    """Warnings about code that runs at compile time become critical."""
    return found.withColumn("severity", F.when(F.col("compile_time") & (F.col("severity") == "warning"), "critical").otherwise(F.col("severity")))
