"""Pre-install reports, trust findings, the dependency tree and report fixes on columns of part, supplier and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import attestation, graph, preinstall
from talus.plans import corpus
from talus.session import table


def pre_install_reports(spark, sf_dir):
    """Every part's name as a package; a third of them are well known, some aren't there, some couldn't be asked for."""
    key, name = F.col("p_partkey"), F.regexp_replace("p_name", " ", "_")
    parts = table(spark, sf_dir, "part")
    first = parts.groupBy(name.alias("package")).agg(F.min_by(F.struct("p_partkey", "p_size"), "p_partkey").alias("p")).select("package", "p.*")
    answers = first.where("p_partkey % 10 <> 5").select(
        "package", F.when(key % 10 == 0, 404).otherwise(200).alias("status"), (F.col("p_size") * 50).alias("downloads"), (key % 3).alias("owners"), (key % 17 == 0).alias("retired"),
        F.when(key % 4 != 0, "d").alias("description"), (key % 20).alias("days"), F.when(key % 6 != 0, "1.0.0").alias("previous_version"), F.lit("1.1.0").alias("latest_version"),
    )
    steps = first.where("p_partkey % 7 = 0").select("package", F.explode(F.array(F.lit("unexpected_new_files"), F.lit("profile_shift"))).alias("signal"))
    known = first.where("p_partkey % 3 = 0").select(F.col("package").alias("name"), key.alias("place"))
    found = preinstall.assessed(first, answers, known, steps)
    joined = lambda c: F.array_join(c, " / ").alias(c)
    return found.select("package", "phantom", joined("similar"), joined("transitions"), "assessment", "warned")


def trust_findings(spark, sf_dir):
    """Suppliers' manifests (their first items) against keys and local profiles (their later ones)."""
    items = table(spark, sf_dir, "lineitem")
    package, module = F.col("l_suppkey").cast("string"), F.concat(F.lit("M"), (F.col("l_partkey") % 200).cast("string"))
    supplier = F.col("l_suppkey")
    declared = items.where("l_linenumber <= 2 and l_suppkey % 4 <> 0").groupBy(package.alias("package"), module.alias("module")).agg(F.max("l_quantity").cast("int").cast("string").alias("content_hash"))
    declared = declared.groupBy("package").agg(F.collect_list(F.struct("module", "content_hash")).alias("module_hashes")).withColumn("version", F.lit("1.0.0"))
    local = items.where("l_linenumber <= 3").groupBy(package.alias("package"), module.alias("module")).agg(F.max("l_quantity").cast("int").cast("string").alias("digest"))
    local = local.where("module <> 'M7'")
    installs = items.select(package.alias("package"), F.when(supplier % 9 != 0, "1.0.0").alias("version")).distinct()
    verdicts = items.select(package.alias("package"), F.lit("1.0.0").alias("version"), F.concat(F.lit("k"), (supplier % 3).cast("string")).alias("key"), (supplier % 5 != 0).alias("valid")).distinct()
    keys = attestation.trusted_keys(*[spark.createDataFrame([(k,)], "key string") for k in ("k0", "k1")])
    return attestation.findings(installs, declared, verdicts, keys, local, "require")


def dependency_tree(spark, sf_dir):
    """Every part with its children, whether it is direct, and its depth."""
    nodes, edges = corpus._graph(spark, sf_dir)
    direct = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("node")).select("node")
    found = graph.tree(nodes, edges.union(edges.where("src % 2 = 0").select("src", ((F.col("src") + 1) % nodes.count()).alias("dst"))), direct, hops=8)
    return found.select("node", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"), "direct", "depth")


PRE_SQL = """
WITH f AS (SELECT replace(p_name, ' ', '_') AS package, min(p_partkey) AS k, arg_min(p_size, p_partkey) AS size FROM part GROUP BY 1),
pairs AS (SELECT f.package, w.package AS known, w.k AS place, CASE WHEN levenshtein(f.package, w.package) = 1 THEN 'edit'
            WHEN length(f.package) = length(w.package) AND levenshtein(f.package, w.package) = 2 AND damerau_levenshtein(f.package, w.package) = 1 THEN 'swap'
            WHEN regexp_replace(f.package, '[-_.]', '', 'g') = regexp_replace(w.package, '[-_.]', '', 'g') THEN 'separator' END AS kind
          FROM f, f AS w WHERE w.k % 3 = 0 AND f.package <> w.package),
near AS (SELECT package, string_agg('similar to ' || known || ' (' || kind || ')', ' / ' ORDER BY place, known) AS sim FROM pairs WHERE kind IS NOT NULL GROUP BY 1),
j AS (SELECT f.*, k % 10 = 0 AS phantom, k % 10 NOT IN (0, 5) AS answered, coalesce(near.sim, '') AS sim,
      CASE WHEN k % 10 NOT IN (0, 5) AND k % 6 <> 0 AND k % 7 = 0 THEN 'Version 1.0.0 → 1.1.0: profile_shift / Version 1.0.0 → 1.1.0: unexpected_new_files' ELSE '' END AS transitions FROM f LEFT JOIN near USING (package)),
w AS (SELECT *, k % 10 <> 5 AS listed, concat_ws('; ', CASE WHEN k % 10 <> 5 AND k % 20 < 7 THEN 'Latest version published ' || (k % 20) || ' days ago' END, CASE WHEN transitions <> '' THEN 'Suspicious version transition' END,
        CASE WHEN sim <> '' THEN 'Possible typosquat' END, CASE WHEN answered AND k % 4 = 0 THEN 'No package description' END, CASE WHEN k % 10 <> 5 AND k % 17 = 0 THEN 'Package is retired' END,
        CASE WHEN k % 10 <> 5 AND k % 3 = 1 THEN 'Single package owner' END, CASE WHEN k % 10 <> 5 AND size * 50 < 1000 THEN 'Low download count (' || (size * 50) || ')' END) AS said FROM j)
SELECT package, phantom, sim AS "similar", transitions,
  CASE WHEN phantom THEN 'CRITICAL: Package does not exist on hex.pm.' || CASE WHEN sim <> '' THEN ' Also similar to known packages: ' || replace(sim, ' / ', '; ') || '. Likely slopsquatting target.'
         ELSE ' Verify the package name is correct before installing.' END
       WHEN said = '' THEN 'No concerns identified.' ELSE 'Warnings: ' || said END AS assessment,
  phantom OR sim <> '' OR transitions <> '' OR (listed AND (size * 50 < 1000 OR k % 3 = 1 OR k % 17 = 0 OR k % 20 < 7)) AS warned FROM w"""

TRUST_SQL = """
WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS package, l_suppkey AS s, 'M' || (l_partkey % 200) AS module, l_linenumber AS n, CAST(l_quantity AS INT) AS q FROM lineitem),
d AS (SELECT package, s, module, max(q) AS h FROM x WHERE n <= 2 AND s % 4 <> 0 GROUP BY ALL), l AS (SELECT package, module, max(q) AS h FROM x WHERE n <= 3 AND module <> 'M7' GROUP BY ALL),
i AS (SELECT DISTINCT package, s, s IN (SELECT s FROM d) AS signed, s % 3 < 2 AND s % 5 <> 0 AS trusted FROM x WHERE s % 9 <> 0)
SELECT package, '1.0.0' AS version, 'attestation_unsigned' AS check_id, 'warning' AS severity, NULL AS module, NULL AS status FROM i WHERE NOT signed
UNION ALL SELECT package, '1.0.0', 'attestation_untrusted', 'critical', NULL, NULL FROM i WHERE signed AND NOT trusted
UNION ALL SELECT d.package, '1.0.0', 'attestation_hash_mismatch', 'critical', d.module, CASE WHEN l.h IS NULL THEN 'missing' ELSE 'mismatch' END
FROM d JOIN i ON i.package = d.package AND i.trusted LEFT JOIN l ON l.package = d.package AND l.module = d.module WHERE l.h IS NULL OR l.h <> d.h"""

TREE_SQL = """
WITH RECURSIVE nodes AS (SELECT p_partkey AS node FROM part), edges AS (
  SELECT p_partkey AS src, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS dst FROM part
  UNION SELECT p_partkey, (p_partkey + 1) % (SELECT count(*) FROM part) FROM part WHERE p_partkey % 2 = 0),
direct AS (SELECT min(p_partkey) AS node FROM part GROUP BY p_brand),
walk AS (SELECT DISTINCT node, 1 AS depth FROM direct UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 60),
best AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
kids AS (SELECT src AS node, string_agg(dst, ',' ORDER BY dst) AS children FROM edges GROUP BY src)
SELECT node, coalesce(children, '') AS children, node IN (SELECT node FROM direct) AS direct, CAST(coalesce(depth, 1) AS BIGINT) AS depth FROM nodes LEFT JOIN kids USING (node) LEFT JOIN best USING (node)"""

QUERIES = {"pre_install_reports": pre_install_reports, "trust_findings": trust_findings, "dependency_tree": dependency_tree}
ORACLES = {"pre_install_reports": PRE_SQL, "trust_findings": TRUST_SQL, "dependency_tree": TREE_SQL}
