"""The publish service run over files that Spark writes from the orders, its sinks read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators.scoring import package_scores
from talus.session import scratch, table
from talus.streaming import service

FILES, FILES_PER_BATCH = 8, 3


def _lines(spark, sf_dir) -> DataFrame:
    """An event line for each order; some are cut off, some name no package, some report a shift."""
    key = F.col("o_orderkey")
    shift = F.when(key % 50 == 0, ',"shift":"high"').otherwise("")
    line = F.format_string('{"package":"p%d","version":"1.%d.0","seq":%d%s}', F.col("o_custkey") % 300, key % 4, key, shift)
    line = F.when(key % 37 == 1, F.left(line, F.lit(20))).when(key % 37 == 2, F.format_string('{"version":"1","seq":%d}', key)).otherwise(line)
    return table(spark, sf_dir, "orders").select(line.alias("value"))


def _scores(spark, sf_dir) -> DataFrame:
    """What the scan says of each package: items are findings, their parts files; every third package has none."""
    found = table(spark, sf_dir, "lineitem").where("l_suppkey % 300 % 3 <> 0 and l_linenumber = 1 and l_quantity > 45").select(
        F.concat(F.lit("p"), (F.col("l_suppkey") % 300).cast("string")).alias("dep"), F.concat(F.lit("f"), (F.col("l_partkey") % 4).cast("string")).alias("file_path"), F.col("l_returnflag").alias("category"),
        F.when(F.col("l_linestatus") == "F", "warning").otherwise("info").alias("severity"), F.lit(False).alias("compile_time"), F.lit(0).alias("evidence"),
    )
    return package_scores(found)


def publish_service(spark, sf_dir):
    """Every row of every sink, and the newest scan of each package version, after the stream has run in batches."""
    root = scratch(spark, "service")
    _lines(spark, sf_dir).repartition(FILES).write.text(f"{root}/in")
    service.start(spark, f"{root}/in", _scores(spark, sf_dir), f"{root}/out", f"{root}/checkpoint", FILES_PER_BATCH).awaitTermination()
    sink = lambda name: service.sink(spark, f"{root}/out", name)
    row = lambda df, kind, **given: df.select(
        F.lit(kind).alias("kind"), *[given.get(c, F.col(c)).cast(t).alias(c) for c, t in (("package", "string"), ("version", "string"), ("seq", "long"), ("risk_score", "long"), ("note", "string"))]
    )
    none = F.lit(None)
    return (
        row(sink("risk_timeline"), "timeline", note=none)
        .union(row(service.latest(sink("package_scans")), "newest", note=F.col("risk_level")))
        .union(row(sink("reviews"), "review", note=F.col("finding_count")))
        .union(row(sink("notifications"), "notification", note=F.col("shift")))
        .union(row(sink("dead_letters"), "dead", package=none, version=none, seq=none, risk_score=none, note=F.concat("reason", F.lit(": "), "value")))
    )


SERVICE_SQL = """
WITH f AS (SELECT 'p' || (l_suppkey % 300) AS package, l_partkey % 4 AS file, l_returnflag AS category, max(CASE WHEN l_linestatus = 'F' THEN 5 ELSE 1 END) + count(*) - 1 AS bucket, count(*) AS n
           FROM lineitem WHERE l_suppkey % 300 % 3 <> 0 AND l_linenumber = 1 AND l_quantity > 45 GROUP BY ALL),
s AS (SELECT package, CAST(sum(n) AS BIGINT) AS n, CAST(least(100, sum(bucket)) AS BIGINT) AS score FROM f GROUP BY package),
raw AS (SELECT o_orderkey AS seq, 'p' || (o_custkey % 300) AS package, '1.' || (o_orderkey % 4) || '.0' AS version, CASE WHEN o_orderkey % 50 = 0 THEN 'high' END AS shift, o_orderkey % 37 AS k FROM orders),
e AS (SELECT raw.*, coalesce(s.n, 0) AS n, coalesce(s.score, 0) AS risk_score FROM raw LEFT JOIN s USING (package) WHERE k NOT IN (1, 2))
SELECT 'timeline' AS kind, package, version, seq, risk_score, NULL AS note FROM e
UNION ALL SELECT 'newest', package, version, max(seq), any_value(risk_score), CASE WHEN any_value(risk_score) >= 80 THEN 'critical' WHEN any_value(risk_score) >= 50 THEN 'high' WHEN any_value(risk_score) >= 20 THEN 'medium' ELSE 'low' END FROM e GROUP BY package, version
UNION ALL SELECT 'review', package, version, seq, risk_score, CAST(n AS VARCHAR) FROM e WHERE n > 0 AND risk_score >= 30
UNION ALL SELECT 'notification', package, version, seq, risk_score, shift FROM e WHERE risk_score >= 80 OR shift = 'high'
UNION ALL SELECT 'dead', NULL, NULL, NULL, NULL, CASE k WHEN 1 THEN 'no JSON: ' || left('{"package":"' || package || '","version":"' || version || '","seq":' || seq || '}', 20) ELSE 'no package: {"version":"1","seq":' || seq || '}' END FROM raw WHERE k IN (1, 2)"""

QUERIES = {"publish_service": publish_service}
ORACLES = {"publish_service": SERVICE_SQL}
