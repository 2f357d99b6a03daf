"""Queries over packages: links, metadata, versions, incidents, reviews, native code, patches, sandboxes, modules.

The tables at hand hold no packages, so part, orders and lineitem stand for them: each query derives the
columns of its operator from whole tables and runs the operator on them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import paths, text
from talus.functions.versions import version_key
from talus.operators import capabilities, incidents, links, metadata, native, patches, profiles, review, sandbox, service, transitions
from talus.session import table

# Imports that the modules of the queries below draw from.
IMPORTS = (
    "ssh.connect/3",
    "os.cmd/1",
    "erlang.apply/3",
    "erlang.binary_to_term/1",
    "inets.start/0",
    "erlang.list_to_atom/1",
    "Elixir.String.to_atom/1",
    "erlang.binary_to_atom/2",
    "erlang.make_fun/3",
    "gen_tcp.connect/3",
    "file.read_file/1",
    "inet_res.lookup/3",
    "erlang.load_nif/2",
    "lists.map/2",
    "epp.open/1",
    "Elixir.Enum.map/2",
    "erlang.fun_info/2",
    "crypto.hash/2",
)
DECLARED = ("network", "file_read", "system_exec", "telepathy", "dns")


def shady_link_lines(spark, sf_dir):
    """Lines of pages and documents with suspicious links."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.concat_ws("\n", "url", "html").alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    lines = text.lines(pages.union(docs).where("text is not null"), "id", "text")
    return links.shady_links(lines).groupBy("id", "reason").agg(F.count("*").alias("n"))


def _meta(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        (F.col("p_partkey") % 13 != 0).alias("known"),
        F.when(F.col("p_partkey") % 11 == 0, "git").when(F.col("p_partkey") % 11 == 1, "path").otherwise("hex").alias("source"),
        F.when(F.col("p_partkey") % 7 != 0, F.floor(F.col("p_retailprice") * F.col("p_size") / 10).cast("long")).alias("downloads"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("days"),
        (F.col("p_partkey") % 4).cast("int").alias("owners"),
        F.when(F.col("p_partkey") % 6 == 0, "").when(F.col("p_partkey") % 6 != 1, F.col("p_type")).alias("description"),
        (F.col("p_partkey") % 8).cast("int").alias("depth"),
        (F.col("p_partkey") % 17 == 0).alias("retired"),
    )


META_SQL = """
  SELECT p_partkey, p_partkey % 13 <> 0 AS known,
         CASE p_partkey % 11 WHEN 0 THEN 'git' WHEN 1 THEN 'path' ELSE 'hex' END AS source,
         CASE WHEN p_partkey % 7 <> 0 THEN CAST(floor(p_retailprice * p_size / 10) AS BIGINT) END AS downloads,
         CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS days, p_partkey % 4 AS owners,
         CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 6 <> 1 THEN p_type END AS description,
         p_partkey % 8 AS depth, p_partkey % 17 = 0 AS retired
  FROM part"""


def registry_penalties(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    return meta.select("p_partkey", metadata.penalty(meta).alias("penalty"), metadata.has_warnings().alias("warns"))


def valid_package_names(spark, sf_dir):
    name = F.regexp_replace(F.lower("p_name"), " ", F.lit("_"))
    name = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("9"), name)).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", paths.valid_name(name).alias("valid"))


def _versions(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    version = F.concat_ws(".", (F.col("l_orderkey") % 3).cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"))
    version = F.when(F.col("l_orderkey") % 5 == 0, F.concat(version, F.lit("-rc."), (F.col("l_orderkey") % 12).cast("string"))).when(F.col("l_orderkey") % 23 == 0, F.concat(F.lit("v"), version)).otherwise(version)
    return items.select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("name"), version.alias("version"))


def _incidents(spark, sf_dir):
    ops = F.array(*map(F.lit, ("any", "eq", "lt", "lte", "gte", "range")))
    s = F.col("s_suppkey")
    low = F.concat_ws(".", (s % 3).cast("string"), (s % 50).cast("string"), F.lit("4"))
    return table(spark, sf_dir, "supplier").select(
        s.cast("string").alias("name"),
        F.element_at(ops, (s % 6 + 1).cast("int")).alias("op"),
        F.when(s % 4 == 0, F.concat(low, F.lit("-rc.9"))).otherwise(low).alias("low"),
        F.lit("2.10.0").alias("high"),
        F.when(s % 2 == 0, F.array(F.lit("A"), F.lit("N"))).alias("categories"),
        F.when(s % 3 == 0, F.array(F.lit("F"))).alias("check_ids"),
    )


VERSION_SQL = """
  v AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS name, l_returnflag, l_linestatus,
          l_orderkey % 3 AS a, CAST(l_quantity AS INT) AS b, l_linenumber AS c,
          CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey % 12 END AS rc,
          l_orderkey % 5 <> 0 AND l_orderkey % 23 = 0 AS invalid FROM lineitem),
  inc AS (SELECT CAST(s_suppkey AS VARCHAR) AS name, ['any', 'eq', 'lt', 'lte', 'gte', 'range'][s_suppkey % 6 + 1] AS op,
          s_suppkey % 3 AS a, s_suppkey % 50 AS b, 4 AS c, CASE WHEN s_suppkey % 4 = 0 THEN 9 END AS rc, s_suppkey AS s FROM supplier),
  hit AS (SELECT v.*, inc.s FROM v JOIN inc ON v.name = inc.name WHERE CASE op WHEN 'any' THEN true
          WHEN 'eq' THEN NOT invalid AND v.a = inc.a AND v.b = inc.b AND v.c = inc.c AND v.rc IS NOT DISTINCT FROM inc.rc
          WHEN 'lt' THEN NOT invalid AND [v.a, v.b, v.c, coalesce(v.rc, 99)] < [inc.a, inc.b, inc.c, coalesce(inc.rc, 99)]
          WHEN 'lte' THEN NOT invalid AND [v.a, v.b, v.c, coalesce(v.rc, 99)] <= [inc.a, inc.b, inc.c, coalesce(inc.rc, 99)]
          WHEN 'gte' THEN NOT invalid AND [v.a, v.b, v.c, coalesce(v.rc, 99)] >= [inc.a, inc.b, inc.c, coalesce(inc.rc, 99)]
          ELSE NOT invalid AND [v.a, v.b, v.c, coalesce(v.rc, 99)] >= [inc.a, inc.b, inc.c, coalesce(inc.rc, 99)]
               AND [v.a, v.b, v.c, coalesce(v.rc, 99)] <= [2, 10, 0, 99] END)"""


def semver_incidents(spark, sf_dir):
    found = incidents.matching(_versions(spark, sf_dir), _incidents(spark, sf_dir))
    return found.select("l_orderkey", "l_linenumber", "name", "op", version_key(F.col("version"))["minor"]["digits"].try_cast("long").alias("minor"))


def promoted_findings(spark, sf_dir):
    """Evidence of findings by supplier, category (return flag) and check (line status)."""
    found = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("name"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("check_id"), F.lit("pattern_match").alias("evidence")
    )
    packages = _versions(spark, sf_dir).where("l_linenumber = 1")
    return incidents.promoted(found, packages, _incidents(spark, sf_dir)).groupBy("name", "category", "check_id", "evidence").agg(F.count("*").alias("n"))


def _reviews(spark, sf_dir):
    """A review text for each order, one line for some of its items and one overall."""
    items = table(spark, sf_dir, "lineitem")
    word = F.element_at(F.array(*map(F.lit, ("CONFIRMED", "refuted", "Uncertain", "maybe"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    line = F.concat(F.lit("Finding #"), F.greatest(F.lit(1), F.col("l_linenumber") - F.col("l_suppkey") % 2).cast("string"), F.lit(":  "), word, F.lit(" as seen"))
    texts = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    tail = F.when(F.col("l_orderkey") % 3 == 0, "\nOVERALL: malicious").when(F.col("l_orderkey") % 3 == 1, "\nOverall: BENIGN").otherwise("\nno verdict")
    return texts.withColumn("text", F.concat("text", tail))


REVIEW_SQL = """
  lines AS (SELECT l_orderkey, l_linenumber, greatest(1, l_linenumber - l_suppkey % 2) AS position,
            ['confirmed', 'refuted', 'uncertain', NULL][l_partkey % 4 + 1] AS verdict,
            'Finding #' || greatest(1, l_linenumber - l_suppkey % 2) || ':  ' || ['CONFIRMED', 'refuted', 'Uncertain', 'maybe'][l_partkey % 4 + 1] AS line FROM lineitem),
  given AS (SELECT l_orderkey, position, arg_max(verdict, {'n': l_linenumber, 'line': line}) AS verdict FROM lines WHERE verdict IS NOT NULL GROUP BY ALL)"""


def judgment_verdicts(spark, sf_dir):
    """Verdicts parsed from review texts, with each review's overall one."""
    texts = _reviews(spark, sf_dir)
    return review.verdicts(texts, "l_orderkey", "text").join(review.overall(texts, "l_orderkey", "text"), "l_orderkey")


def judged_findings(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_quantity") >= 30, "critical").when(F.col("l_quantity") >= 10, "warning").otherwise("info").alias("severity"), F.lit("pattern_match").alias("evidence")
    )
    out = review.judged(found, review.verdicts(_reviews(spark, sf_dir), "l_orderkey", "text"), "l_orderkey", ["l_linenumber", "l_quantity"])
    return out.groupBy("severity", "evidence").agg(F.count("*").alias("n"))


def native_artifacts(spark, sf_dir):
    """Native code findings of the files that documents stand for: sources are packages."""
    names = F.array(*map(F.lit, ("priv/lib/core.so", "c_src/main.c", "Makefile", "mix.exs", "lib/a.ex", "priv/data.txt", "native/x/lib.rs", "lib/c_src.ex", "priv/x.dll")))
    k = F.col("doc_id") % 9
    content = F.when((k == 3) & (F.col("doc_id") % 2 == 0), "compilers: [:elixir_make] ++ Mix.compilers()").otherwise(F.col("text"))
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", (F.col("doc_id") % 40).cast("string")).alias("dep"), F.element_at(names, (k + 1).cast("int")).alias("path"), content.alias("content"))
    return native.native_findings(files)


def _findings(spark, sf_dir):
    """Findings with what patches need of them: one for each part."""
    p = F.col("p_partkey")
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key + 1).cast("int"))
    name = F.regexp_replace("p_name", " ", "_")
    return table(spark, sf_dir, "part").select(
        name.alias("dep"),
        pick(("typosquat", "phantom_package", "version_transition", "system_exec", "temporal_anomaly", "code_eval"), p % 6).alias("check_id"),
        pick(("metadata", "metadata", "version_transition", "system_exec", "temporal_anomaly", "code_eval"), p % 6).alias("category"),
        F.when(p % 5 == 0, "warning").otherwise("critical").alias("severity"),
        (p % 4 != 0).alias("compile_time"),
        F.when(p % 12 == 0, F.concat(F.lit("likely typosquat of :"), F.lower("p_brand").substr(1, 5))).otherwise(F.lit("nothing like it")).alias("description"),
        F.when(p % 7 != 0, F.concat((p % 3).cast("string"), F.lit("."), (p % 10).cast("string"), F.lit(".1"))).alias("previous_version"),
        F.when(p % 12 == 1, F.lit("known")).alias("known"),
        p.alias("place"),
    )


def patch_plan(spark, sf_dir):
    """The first patch of each target, renames verified against the brands without a cheap part."""
    part = table(spark, sf_dir, "part")
    clean = part.groupBy(F.lower("p_brand").substr(1, 5).alias("name")).agg(F.min("p_retailprice").alias("low")).where("low > 0")
    return patches.suggestions(_findings(spark, sf_dir), clean).select("dep", "action", "target", "version", "category", "verified", F.md5("diff").alias("diff_md5"))


def report_fixes(spark, sf_dir):
    """How many patches a report lists for the findings of each category."""
    found = _findings(spark, sf_dir)
    return patches.fixes(found.select("dep", "category", "place"), patches.suggestions(found)).groupBy("category", "action").agg(F.count("*").alias("n"))


PATCH_SQL = """
  f AS (SELECT replace(p_name, ' ', '_') AS dep, p_partkey AS p,
        ['metadata', 'metadata', 'version_transition', 'system_exec', 'temporal_anomaly', 'code_eval'][p_partkey % 6 + 1] AS category,
        CASE WHEN p_partkey % 12 = 0 THEN substr(lower(p_brand), 1, 5) WHEN p_partkey % 12 = 1 THEN 'known' END AS near,
        CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 3) || '.' || (p_partkey % 10) || '.1' END AS prev FROM part),
  m AS (SELECT *, CASE WHEN near IS NOT NULL AND p % 6 < 2 THEN 'rename_package' WHEN p % 6 = 1 THEN 'remove_dependency' WHEN p % 6 = 0 THEN NULL
              WHEN p % 6 IN (2, 4) AND prev IS NOT NULL THEN 'pin_to_version'
              WHEN p % 4 <> 0 AND p % 5 <> 0 AND p % 6 IN (3, 5) THEN 'remove_dependency' END AS action FROM f),
  t AS (SELECT *, CASE action WHEN 'rename_package' THEN near WHEN 'pin_to_version' THEN dep END AS target FROM m WHERE action IS NOT NULL),
  patch AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY dep, action, target ORDER BY p) = 1)"""


def sandbox_report_findings(spark, sf_dir):
    """Findings of reports that orders stand for: items are what was seen."""
    items = table(spark, sf_dir, "lineitem")
    seen = lambda flag, make: F.collect_list(F.when(F.col("l_returnflag") == flag, make))
    path = F.concat(F.when(F.col("l_linestatus") == "F", "/work/x/").otherwise("/home/u/"), F.col("l_linenumber").cast("string"))
    reports = items.groupBy("l_orderkey").agg(
        seen("A", F.concat(F.lit("op "), F.col("l_linenumber").cast("string"))).alias("denied"),
        seen("N", path).alias("written"),
        seen("R", F.concat(F.lit("h"), F.col("l_linenumber").cast("string"), F.lit(":443"))).alias("network"),
        seen("R", F.concat(F.lit("sh"), F.col("l_linenumber").cast("string"))).alias("spawned"),
    )
    reports = reports.select(F.col("l_orderkey").alias("dep"), (F.col("l_orderkey") % 4 != 0).alias("available"), F.lit("/work/").alias("workdir"), "denied", "written", "network", "spawned")
    return sandbox.sandbox_findings(reports).groupBy("dep", "check_id", "severity").agg(F.count("*").alias("n"), F.min("target").alias("first"))


def _import(spark, sf_dir):
    pick = F.element_at(F.array(*map(F.lit, IMPORTS)), (F.col("l_partkey") % len(IMPORTS) + 1).cast("int"))
    name, arity = F.substring_index(pick, "/", 1), F.substring_index(pick, "/", -1).cast("int")
    func = F.substring_index(name, ".", -1)
    module = F.left(name, F.length(name) - F.length(func) - 1)
    return F.struct(module.alias("m"), func.alias("f"), arity.alias("a"))


def _modules(spark, sf_dir, early: bool | None = None):
    """A module for each order: its items are imports, their number of units the dispatch count."""
    items = table(spark, sf_dir, "lineitem").withColumn("i", _import(spark, sf_dir))
    if early is not None:
        items = items.where((F.col("l_linenumber") <= 3) if early else (F.col("l_linenumber") > 1))
    made = items.groupBy("l_orderkey").agg(F.collect_list("i").alias("imports"), F.floor(F.sum("l_quantity") / 10).cast("int").alias("dispatch"), F.collect_list(F.concat(F.lit("host"), F.col("l_suppkey").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, ".example.org").otherwise(""))).alias("atoms"))
    handler = F.array(F.struct(F.lit("$handle_undefined_function").alias("f"), F.lit(2).alias("a")))
    exports = F.when(F.col("l_orderkey") % 10 == 0, handler).otherwise(F.array().cast("array<struct<f:string,a:int>>"))
    return made.select(F.lit("ebin").alias("path"), F.col("l_orderkey").cast("string").alias("module"), "imports", exports.alias("exports"), "atoms", "dispatch")


def dangerous_imports(spark, sf_dir):
    return profiles.import_findings(_modules(spark, sf_dir)).select("module", "target", "severity")


def reflection_findings(spark, sf_dir):
    """Handlers, decode-and-dispatch and density of reflection by module."""
    found = _modules(spark, sf_dir)
    dense = profiles.reflection_density(found).select("module", F.concat(F.lit("density "), "severity").alias("finding"))
    return profiles.reflection(found).select("module", "finding").union(dense)


def module_delta_findings(spark, sf_dir):
    """What the later items of an order bring against its first ones."""
    found = profiles.delta_findings(_modules(spark, sf_dir, True), _modules(spark, sf_dir, False))
    return found.select("module", "check_id", "severity", F.array_join("examples", ",").alias("examples"))


def prior_cached_versions(spark, sf_dir):
    cached = _versions(spark, sf_dir).select(F.col("name").alias("dep"), "version").distinct()
    now = cached.groupBy("dep").agg(F.min("version").alias("version"))
    return profiles.prior_versions(cached, now)


def capability_findings(spark, sf_dir):
    """Capabilities that suppliers' imports show against those declared by their own rows."""
    i = _import(spark, sf_dir)
    used = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("dep"), i["m"].alias("m"), i["f"].alias("f"))
    declared = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(
        F.col("s_suppkey").alias("dep"), F.element_at(F.array(*map(F.lit, DECLARED)), (F.col("s_suppkey") % len(DECLARED) + 1).cast("int")).alias("capability")
    )
    return capabilities.mismatches(declared, capabilities.observed(used))


def transition_findings(spark, sf_dir):
    """Steps and look backs of packages (customers) by the files (orders) of their two halves of the year."""
    orders = table(spark, sf_dir, "orders")
    c = F.col("o_custkey")
    path = F.concat(F.when(F.col("o_orderkey") % 6 == 0, "test/").otherwise("lib/"), (F.col("o_orderkey") % 30).cast("string"))
    files = orders.select(c.alias("dep"), path.alias("path"), (F.month("o_orderdate") <= 6).alias("old"))
    fresh = transitions.unexpected_files(files.where("old"), files.where("not old")).select("dep", F.lit("unexpected_new_files").alias("signal"))
    signals = fresh.union(fresh.where("dep % 5 = 0").select("dep", F.lit("profile_shift")))
    signals = signals.withColumn("against", F.explode(F.array(F.lit("previous"), F.lit("lookback"))))
    steps = orders.select(c.alias("dep")).distinct().select(
        "dep", F.lit("1.2.0").alias("current"), F.when(F.col("dep") % 4 != 0, F.concat(F.lit("1."), (F.col("dep") % 3).cast("string"), F.lit(".0"))).alias("previous"), F.when(F.col("dep") % 3 != 1, "1.1.0").alias("lookback")
    )
    return transitions.transition_findings(steps, signals)


def stored_scans(spark, sf_dir):
    """Scan rows that can't be stored, by what is wrong, beside those that can."""
    status = F.element_at(F.array(*map(F.lit, ("pending", "scanning", "completed", "failed", "lost"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    level = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical", "odd", "dire"))), (F.col("o_custkey") % 6 + 1).cast("int"))
    scans = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), level.alias("risk_level"), (F.col("o_totalprice") / 400000).alias("ratio"))
    fine, bad = service.parted(scans)
    return fine.select(F.lit("stored").alias("outcome")).union(bad.select("problem")).groupBy("outcome").agg(F.count("*").alias("n"))


def path_texts(spark, sf_dir):
    """Paths, module names and snippets as reports show them."""
    path = F.concat(F.lit("/home/u/app/deps/"), F.regexp_replace("p_name", " ", "/"))
    path = F.when(F.col("p_partkey") % 5 == 0, F.lit("/srv/x/lib.ex")).otherwise(path)
    return table(spark, sf_dir, "part").select(
        "p_partkey", paths.shortened(path).alias("short"), paths.base_name(path).alias("base"), paths.slug(F.col("p_type")).alias("slug"), paths.summary(F.concat_ws(", ", "p_name", "p_type", "p_brand"), 24).alias("summary")
    )


QUERIES = {
    f.__name__: f
    for f in (
        shady_link_lines, registry_penalties, valid_package_names, semver_incidents, promoted_findings, judgment_verdicts, judged_findings, native_artifacts,
        patch_plan, report_fixes, sandbox_report_findings, dangerous_imports, reflection_findings, module_delta_findings, prior_cached_versions,
        capability_findings, transition_findings, stored_scans, path_texts,
    )
}

_SHADY = " ".join(f"UNION ALL SELECT id, '{reason}' AS reason FROM held WHERE regexp_matches(line, '{pattern.replace(chr(39), chr(39) * 2).replace(chr(92) + chr(34), chr(34))}')" for pattern, reason in links.LINKS)
_IMPORT_SQL = "[" + ", ".join(f"'{x}'" for x in IMPORTS) + f"][l_partkey % {len(IMPORTS)} + 1]"
_WILD = ", ".join(f"'{m}'" for m in profiles.WILD_MODULES)
_SINGLE = ", ".join(f"'{m}'" for m in profiles.SINGLE_IMPORTS)
_DANGER = f"(regexp_extract(i, '^(.*)[.][^.]*/', 1) IN ({_WILD}) OR split_part(i, '/', 1) IN ({_SINGLE}))"
_SHOWN = ", ".join(f"('{m}', '{f}', '{c}')" for m, f, caps in capabilities.SHOWN for c in caps.split())

ORACLES = {
    "shady_link_lines": f"""
WITH texts AS (SELECT 'p' || page_id AS id, concat_ws(chr(10), url, html) AS text FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents),
lines AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM texts WHERE text IS NOT NULL),
held AS (SELECT * FROM lines WHERE NOT starts_with(ltrim(line, ' '), '#') AND NOT contains(line, '~r/') AND NOT contains(line, '~R/')),
hits AS (SELECT NULL AS id, NULL AS reason WHERE false {_SHADY})
SELECT id, reason, count(*) AS n FROM hits GROUP BY ALL""",
    "registry_penalties": f"""
SELECT p_partkey, CAST(CASE WHEN known THEN CASE WHEN source <> 'hex' THEN 10 ELSE 0 END + CASE WHEN downloads < 100 THEN 20 WHEN downloads < 1000 THEN 10 ELSE 0 END
  + CASE WHEN days < 7 THEN 15 ELSE 0 END + CASE WHEN owners = 1 THEN 5 ELSE 0 END + CASE WHEN coalesce(description, '') = '' THEN 5 ELSE 0 END
  + CASE WHEN depth >= 5 THEN 10 WHEN depth >= 3 THEN 5 ELSE 0 END ELSE 0 END AS BIGINT) AS penalty,
  coalesce(downloads < 1000, false) OR owners = 1 OR retired OR coalesce(days < 7, false) AS warns FROM ({META_SQL})""",
    "valid_package_names": """
SELECT p_partkey, regexp_full_match(CASE WHEN p_partkey % 9 = 0 THEN '9' ELSE '' END || replace(lower(p_name), ' ', '_'), '[a-z][a-z0-9_]{0,63}') AS valid FROM part""",
    "semver_incidents": f"""WITH {VERSION_SQL}
SELECT l_orderkey, l_linenumber, name, ['any', 'eq', 'lt', 'lte', 'gte', 'range'][s % 6 + 1] AS op, CASE WHEN NOT invalid THEN CAST(b AS BIGINT) END AS minor FROM hit""",
    "promoted_findings": f"""WITH {VERSION_SQL},
known AS (SELECT DISTINCT name, s FROM hit WHERE l_linenumber = 1)
SELECT v.name, l_returnflag AS category, l_linestatus AS check_id,
  CASE WHEN known.s IS NOT NULL AND (s % 2 <> 0 OR l_returnflag IN ('A', 'N')) AND (s % 3 <> 0 OR l_linestatus = 'F') THEN 'known_incident' ELSE 'pattern_match' END AS evidence, count(*) AS n
FROM v LEFT JOIN known ON v.name = known.name GROUP BY ALL""",
    "judgment_verdicts": f"""WITH {REVIEW_SQL}
SELECT *, ['malicious', 'benign', 'uncertain'][l_orderkey % 3 + 1] AS overall FROM given""",
    "judged_findings": f"""WITH {REVIEW_SQL},
f AS (SELECT l_orderkey, CASE WHEN l_quantity >= 30 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END AS tier,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS position FROM lineitem)
SELECT ['info', 'warning', 'critical'][CASE WHEN verdict = 'refuted' THEN greatest(0, tier - 1) ELSE tier END + 1] AS severity,
  CASE WHEN verdict = 'confirmed' THEN 'llm_confirmed' ELSE 'pattern_match' END AS evidence, count(*) AS n
FROM f LEFT JOIN given USING (l_orderkey, position) GROUP BY ALL""",
    "native_artifacts": """
WITH f AS (SELECT source || '/' || (doc_id % 40) AS dep, doc_id % 9 AS k, doc_id, text FROM documents),
c AS (SELECT dep, CASE k WHEN 0 THEN 'artifact' WHEN 8 THEN 'artifact' WHEN 1 THEN 'source' WHEN 6 THEN 'source' WHEN 2 THEN 'build_file'
      WHEN 3 THEN CASE WHEN doc_id % 2 = 0 OR contains(text, ':elixir_make') OR contains(text, ':rustler') THEN 'compiler' END END AS what,
      ['priv/lib/core.so', 'c_src', 'Makefile', 'mix.exs', NULL, NULL, 'native', NULL, 'priv/x.dll'][k + 1] AS target FROM f)
SELECT DISTINCT dep, 'native_code_' || what AS check_id, target, CASE what WHEN 'artifact' THEN 'critical' ELSE 'warning' END AS severity, what <> 'artifact' AS compile_time
FROM c WHERE what IS NOT NULL""",
    "patch_plan": f"""WITH {PATCH_SQL},
clean AS (SELECT substr(lower(p_brand), 1, 5) AS name FROM part GROUP BY 1 HAVING min(p_retailprice) > 0)
SELECT dep, action, target, CASE WHEN action = 'pin_to_version' THEN prev END AS version, CASE action WHEN 'rename_package' THEN 'metadata' ELSE category END AS category,
  action <> 'rename_package' OR target IN (SELECT name FROM clean) AS verified,
  md5(CASE action WHEN 'rename_package' THEN '-      {{:' || dep || ', "~> x.y.z"}},' || chr(10) || '+      {{:' || target || ', "~> x.y.z"}},' || chr(10)
      WHEN 'pin_to_version' THEN '-      {{:' || dep || ', "~> ' || regexp_extract(prev, '^[0-9]+[.][0-9]+') || '"}},' || chr(10) || '+      {{:' || dep || ', "== ' || prev || '"}},' || chr(10)
      ELSE '-      {{:' || dep || ', "~> x.y.z"}},' || chr(10) END) AS diff_md5 FROM patch""",
    "report_fixes": f"""WITH {PATCH_SQL}
SELECT f.category, action, count(*) AS n FROM f JOIN patch ON f.dep = patch.dep
WHERE action = 'remove_dependency' OR (action = 'rename_package' AND f.category = 'metadata') OR (action = 'pin_to_version' AND f.category = patch.category) GROUP BY ALL""",
    "sandbox_report_findings": """
WITH x AS (SELECT l_orderkey AS dep, l_linenumber AS k, l_returnflag AS r, l_linestatus AS s FROM lineitem WHERE l_orderkey % 4 <> 0),
e AS (SELECT dep, 'denied' AS w, 'op ' || k AS target FROM x WHERE r = 'A' UNION ALL SELECT dep, 'write', '/home/u/' || k FROM x WHERE r = 'N' AND s <> 'F'
      UNION ALL SELECT dep, 'network', 'h' || k || ':443' FROM x WHERE r = 'R' UNION ALL SELECT dep, 'subprocess', 'sh' || k FROM x WHERE r = 'R')
SELECT dep, 'sandboxed_compile_' || w AS check_id, CASE w WHEN 'subprocess' THEN 'warning' ELSE 'critical' END AS severity, count(*) AS n, min(target) AS first FROM e GROUP BY ALL""",
    "dangerous_imports": f"""
WITH x AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS module, {_IMPORT_SQL} AS i FROM lineitem)
SELECT module, i AS target, CASE WHEN split_part(i, '/', 1) IN ('inets.start', 'inets.stop') THEN 'warning' ELSE 'critical' END AS severity FROM x WHERE {_DANGER}""",
    "reflection_findings": f"""
WITH x AS (SELECT l_orderkey, {_IMPORT_SQL} AS i, l_quantity FROM lineitem),
m AS (SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) AS module, CAST(floor(sum(l_quantity) / 10) AS INT) AS dispatch, bool_or(i = 'erlang.binary_to_term/1') AS decodes,
      bool_or(i = 'erlang.apply/3') AS applies, count(DISTINCT i) FILTER (i IN ({", ".join(f"'{r}'" for r in profiles.REFLECTION)})) AS kinds FROM x GROUP BY l_orderkey)
SELECT module, 'handle_undefined' AS finding FROM m WHERE l_orderkey % 10 = 0 UNION ALL SELECT module, 'decode_and_dispatch' FROM m WHERE decodes AND (applies OR dispatch > 0)
UNION ALL SELECT module, CASE WHEN kinds >= 5 AND dispatch >= 15 THEN 'density critical' ELSE 'density warning' END FROM m WHERE kinds >= 5 OR dispatch >= 15""",
    "module_delta_findings": f"""
WITH x AS (SELECT CAST(l_orderkey AS VARCHAR) AS module, l_linenumber, l_quantity, l_suppkey, {_IMPORT_SQL} AS i FROM lineitem),
a AS (SELECT module, list(i) AS was, list(l_suppkey) AS hosts, CAST(floor(sum(l_quantity) / 10) AS INT) AS calls FROM x WHERE l_linenumber <= 3 GROUP BY 1),
b AS (SELECT module, list(i) AS now, list(l_suppkey) AS hosts, CAST(floor(sum(l_quantity) / 10) AS INT) AS calls FROM x WHERE l_linenumber > 1 GROUP BY 1),
j AS (SELECT b.module, a.module IS NOT NULL AS known, b.calls - coalesce(a.calls, 0) AS more,
      list_sort(list_distinct([i FOR i IN b.now IF {_DANGER} AND NOT list_contains(coalesce(a.was, []), i)])) AS fresh,
      list_sort(list_distinct(['host' || h || '.example.org' FOR h IN b.hosts IF h % 2 = 0 AND NOT list_contains(coalesce(a.hosts, []), h)])) AS atoms FROM b LEFT JOIN a ON a.module = b.module)
SELECT module, 'beam_delta_dangerous_import' AS check_id, 'critical' AS severity, array_to_string(fresh[1:3], ',') AS examples FROM j WHERE known AND len(fresh) > 0
UNION ALL SELECT module, 'beam_delta_dangerous_import', 'critical', unnest(fresh) FROM j WHERE NOT known
UNION ALL SELECT module, 'beam_delta_dispatch_spike', 'warning', '' FROM j WHERE known AND more >= 3
UNION ALL SELECT module, 'beam_delta_suspicious_atoms', 'warning', array_to_string(atoms[1:3], ',') FROM j WHERE known AND len(atoms) > 0
UNION ALL SELECT module, 'beam_delta_module_added', 'warning', '' FROM j WHERE NOT known""",
    "prior_cached_versions": f"""WITH {VERSION_SQL},
t AS (SELECT DISTINCT name AS dep, CASE WHEN invalid THEN 'v' ELSE '' END || a || '.' || b || '.' || c || CASE WHEN rc IS NOT NULL THEN '-rc.' || rc ELSE '' END AS version FROM v),
n AS (SELECT dep, min(version) AS now FROM t GROUP BY dep)
SELECT dep, max(version) AS prior FROM t JOIN n USING (dep) WHERE version <> now GROUP BY dep""",
    "capability_findings": f"""
WITH x AS (SELECT DISTINCT l_suppkey AS dep, regexp_extract(i, '^(.*)[.][^.]*/', 1) AS m, regexp_extract(i, '([^.]*)/', 1) AS f FROM (SELECT l_suppkey, {_IMPORT_SQL} AS i FROM lineitem WHERE l_linestatus = 'F')),
shown(m, f, capability) AS (VALUES {_SHOWN}),
o AS (SELECT DISTINCT dep, capability FROM x JOIN shown ON x.m = shown.m AND shown.f IN ('*', x.f)),
d AS (SELECT s_suppkey AS dep, ['network', 'file_read', 'system_exec', 'telepathy', 'dns'][s_suppkey % 5 + 1] AS capability FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT dep, capability, 'undeclared_use' AS problem FROM o SEMI JOIN d AS e ON o.dep = e.dep ANTI JOIN d ON o.dep = d.dep AND o.capability = d.capability
UNION ALL SELECT dep, capability, CASE capability WHEN 'telepathy' THEN 'unknown' ELSE 'declared_unused' END FROM d ANTI JOIN o ON o.dep = d.dep AND o.capability = d.capability""",
    "transition_findings": """
WITH f AS (SELECT DISTINCT o_custkey AS dep, CASE WHEN o_orderkey % 6 = 0 THEN 'test/' ELSE 'lib/' END || (o_orderkey % 30) AS path, month(o_orderdate) <= 6 AS old FROM orders),
u AS (SELECT DISTINCT n.dep FROM f n LEFT JOIN f o ON o.old AND o.dep = n.dep AND o.path = n.path WHERE NOT n.old AND o.dep IS NULL AND NOT contains(n.path, 'test')),
s AS (SELECT dep, 'unexpected_new_files' AS signal FROM u UNION ALL SELECT dep, 'profile_shift' FROM u WHERE dep % 5 = 0),
v AS (SELECT *, '1.2.0' AS cur, CASE WHEN dep % 4 <> 0 THEN '1.' || (dep % 3) || '.0' END AS prev, CASE WHEN dep % 3 <> 1 THEN '1.1.0' END AS back FROM s)
SELECT dep, 'version_transition' AS check_id, CASE signal WHEN 'profile_shift' THEN 'critical' ELSE 'warning' END AS severity, prev || ' to ' || cur || ' (' || signal || ')' AS description
FROM v WHERE prev <> cur UNION ALL SELECT dep, 'version_lookback', 'warning', back || ' to ' || cur || ' (' || signal || ')' FROM v WHERE back <> cur AND back IS DISTINCT FROM prev""",
    "stored_scans": """
SELECT CASE WHEN o_orderkey % 5 = 4 THEN 'status' WHEN o_custkey % 6 > 3 THEN 'risk_level' WHEN NOT (o_totalprice / 400000 BETWEEN 0 AND 1) THEN 'ratio' ELSE 'stored' END AS outcome, count(*) AS n
FROM orders GROUP BY 1""",
    "path_texts": """
WITH x AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN '/srv/x/lib.ex' ELSE '/home/u/app/deps/' || replace(p_name, ' ', '/') END AS path FROM part)
SELECT p_partkey, CASE WHEN contains(path, '/deps/') THEN 'deps/' || split_part(path, '/deps/', 2) ELSE path END AS short, regexp_extract(path, '[^/]*$') AS base,
  regexp_replace(p_type, '[^A-Za-z0-9_.-]', '_', 'g') AS slug, left(p_name || ', ' || p_type || ', ' || p_brand, 24) AS summary FROM x""",
}
