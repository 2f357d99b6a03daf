"""Package sources made of the order tables, scanned from text to score.

No table holds sources, so each order is a file of the package of its first supplier and its items are definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators import order, prompts, scan
from talus.session import table

HEAD = "defmodule M%d do\n  alias String, as: S\n  m = System\n"
#: Definitions by part % 8: the text of each (%d: the item's number).
TEXTS = (
    '  def f%d(x), do: m.cmd("id", [x])\n',
    "  defmacro f%d(x,\n      y) do\n    Req.get(x <> y)\n  end\n",
    '  Code.eval_string("%d")\n',
    '  def f%d(x), do: File.read("~/.ssh/id_rsa" <> x)\n',
    "  def f%d(x) do\n    if x, do: 1\n    :gen_tcp.connect(x, 1)\n  end\n",
    "  def f%d(x), do: S.to_atom(x)\n",
    '  # System.cmd("%d")\n',
    "  def f%d(x, y), do: apply(x, y, [])\n",
)
ALLOWED = (("p3", "system_exec"), ("p4", "obfuscation"), ("p5", "network_access"))


def source_texts(spark, sf_dir) -> DataFrame:
    """dep, path, content of a file for each order; orders of a hundred and first place lie among the build tasks."""
    items = table(spark, sf_dir, "lineitem")
    kinds = [F.format_string(t, F.col("l_linenumber")) for t in TEXTS]
    text = F.element_at(F.array(*kinds), (F.col("l_partkey") % 8 + 1).cast("int"))
    made = items.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", text.alias("text")))).alias("made"), F.min_by("l_suppkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("s")
    )
    body = F.array_join(F.transform("made", lambda x: x["text"]), "")
    path = F.concat(F.when(F.col("l_orderkey") % 101 == 0, "deps/x/lib/mix/m").otherwise("deps/x/lib/m"), F.col("l_orderkey").cast("string"), F.lit(".ex"))
    return made.select(F.concat(F.lit("p"), F.col("s").cast("string")).alias("dep"), path.alias("path"), F.concat(F.format_string(HEAD, F.col("l_orderkey")), body, F.lit("end\n")).alias("content"))


def source_findings(spark, sf_dir):
    """Every finding of every file, before allowances."""
    found = scan.correlated(scan.findings(scan.Facts.of(source_texts(spark, sf_dir))))
    return found.select("dep", "path", F.col("line").cast("long").alias("line"), "check_id", "category", "severity", "compile_time", F.col("evidence").cast("long").alias("evidence"))


def scan_sources(spark, sf_dir):
    """Files to scores: facts, checks, correlation, allowances, score, in report order."""
    found = scan.findings(scan.Facts.of(source_texts(spark, sf_dir)))
    scored = scan.scores(scan.scanned(found, spark.createDataFrame(ALLOWED, "dep string, category string")))
    return order.numbered(scored, F.desc("risk_score"), "dep", name="place")


FOUND_SQL = """
WITH items AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_partkey % 8 AS kind, CASE WHEN l_partkey % 8 IN (1, 4) THEN 4 ELSE 1 END AS lines FROM lineitem),
placed AS (SELECT *, 4 + coalesce(sum(lines) OVER (PARTITION BY k ORDER BY n, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first,
           first_value(s) OVER (PARTITION BY k ORDER BY n, p, s) AS dep FROM items),
raw AS (SELECT 'p' || dep AS dep, 'deps/x/lib/' || CASE WHEN k % 101 = 0 THEN 'mix/' ELSE '' END || 'm' || k || '.ex' AS path,
        CAST(first + CASE WHEN kind IN (1, 4) THEN 2 ELSE 0 END AS BIGINT) AS line, k % 101 = 0 AS mix,
        ['system_exec', 'network_access', 'code_eval', 'file_access', 'network_access', 'atom_exhaustion', NULL, 'dynamic_apply'][kind + 1] AS check_id,
        ['critical', 'critical', 'critical', 'critical', 'warning', 'warning', NULL, 'warning'][kind + 1] AS severity, kind IN (1, 2) AS compile_time FROM placed WHERE kind <> 6),
net AS (SELECT DISTINCT dep FROM raw WHERE check_id = 'network_access'),
found AS (SELECT dep, path, line, check_id, CASE check_id WHEN 'atom_exhaustion' THEN 'dos_atom_exhaustion' WHEN 'dynamic_apply' THEN 'obfuscation' ELSE check_id END AS category,
          CASE WHEN check_id = 'dynamic_apply' AND dep IN (SELECT dep FROM net) THEN 'critical' WHEN mix AND NOT compile_time AND severity = 'warning' THEN 'info' ELSE severity END AS severity,
          compile_time, CASE WHEN check_id = 'dynamic_apply' AND dep IN (SELECT dep FROM net) THEN 1 ELSE 0 END::BIGINT AS evidence FROM raw)"""

SCAN_SQL = FOUND_SQL + """,
kept AS (SELECT *, CASE WHEN severity = 'critical' AND compile_time THEN 40 WHEN severity = 'critical' THEN 15 WHEN severity = 'warning' AND compile_time THEN 20 WHEN severity = 'warning' THEN 5 ELSE 1 END AS base
         FROM found WHERE (dep, category) NOT IN (('p3', 'system_exec'), ('p4', 'obfuscation'), ('p5', 'network_access'))),
buckets AS (SELECT dep, path, category, max(CASE WHEN evidence = 1 THEN floor(base * 1.3 + 0.5) ELSE base END) + count(*) - 1 AS bucket, count(*) AS n FROM kept GROUP BY ALL),
scores AS (SELECT dep, CAST(sum(n) AS BIGINT) AS finding_count, CAST(least(100, sum(bucket)) AS BIGINT) AS risk_score FROM buckets GROUP BY dep)
SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 50 THEN 'high' WHEN risk_score >= 20 THEN 'medium' ELSE 'low' END AS risk_level,
       row_number() OVER (ORDER BY risk_score DESC, dep) AS place FROM scores"""

QUERIES = {"source_findings": source_findings, "scan_sources": scan_sources}
ORACLES = {"source_findings": FOUND_SQL + "\nSELECT * FROM found", "scan_sources": SCAN_SQL}


def finding_snippets(spark, sf_dir):
    """Each finding's line with the lines beside it."""
    texts = source_texts(spark, sf_dir)
    found = prompts.snippets(scan.findings(scan.Facts.of(texts)), texts, 1)
    return found.select("dep", "path", F.col("line").cast("long").alias("line"), "check_id", "snippet")


def review_prompts(spark, sf_dir):
    """The prompt of every package with findings, and its length and digest."""
    texts = source_texts(spark, sf_dir)
    found = scan.correlated(scan.findings(scan.Facts.of(texts))).withColumn("description", F.concat(F.lit("found "), "check_id"))
    packages = texts.select("dep").distinct().select("dep", F.lit("1.0.0").alias("version"), F.lit("hex").alias("source"))
    made = prompts.prompts(found, texts, packages)
    return made.select("dep", F.char_length("prompt").cast("long").alias("length"), F.sha2("prompt", 256).alias("digest"))


def _texts_sql() -> str:
    """SQL of the files' texts."""
    kinds = ", ".join("printf('" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "', n)" if "%d" in t else "'" + t + "'" for t in TEXTS)
    head = HEAD.replace("\n", "' || chr(10) || '")
    return f"""
texts AS (SELECT k, any_value(dep) AS s, printf('{head}', k) || string_agg([{kinds}][kind + 1], '' ORDER BY n, p) || 'end' || chr(10) AS content FROM placed GROUP BY k),
files AS (SELECT 'p' || s AS dep, 'deps/x/lib/' || CASE WHEN k % 101 = 0 THEN 'mix/' ELSE '' END || 'm' || k || '.ex' AS path, content FROM texts)"""


SNIPPET_SQL = FOUND_SQL + "," + _texts_sql() + r"""
SELECT dep, path, line, check_id, regexp_replace(regexp_replace(array_to_string(string_split(content, chr(10))[line - 1 : line + 1], chr(10)), '^\s+', ''), '\s+$', '') AS snippet
FROM found JOIN files USING (dep, path)"""

PROMPT_SQL = FOUND_SQL + "," + _texts_sql() + """,
said AS (SELECT dep, path, line, check_id, '[' || severity || CASE WHEN compile_time THEN ' [COMPILE-TIME]' ELSE '' END || '] found ' || check_id || chr(10) || '     File: ' || path || ':' || line AS said,
         row_number() OVER (PARTITION BY dep ORDER BY path, line, check_id) AS i FROM found),
listed AS (SELECT dep, string_agg('  ' || i || '. ' || said, chr(10) ORDER BY i) AS findings FROM said GROUP BY dep),
shown AS (SELECT dep, string_agg('--- ' || path || ' ---' || chr(10) || content, chr(10) || chr(10) ORDER BY path) AS files FROM files SEMI JOIN found USING (dep, path) GROUP BY dep),
made AS (SELECT dep, 'Package ' || dep || ' 1.0.0 (hex)' || chr(10) || chr(10) || 'Findings:' || chr(10) || findings || chr(10) || chr(10) || 'Flagged files:' || chr(10) || files || chr(10) || chr(10)
         || 'Judge each finding, name what else is risky, and give an overall risk.' || chr(10) AS prompt FROM listed JOIN shown USING (dep))
SELECT dep, length(prompt) AS length, sha256(prompt) AS digest FROM made"""

QUERIES |= {"finding_snippets": finding_snippets, "review_prompts": review_prompts}
ORACLES |= {"finding_snippets": SNIPPET_SQL, "review_prompts": PROMPT_SQL}
