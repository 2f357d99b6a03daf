"""Registry answers and stored histories made of the order tables as JSON, read back part by part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.session import table
from talus.sources import registry


def _answers(spark, sf_dir) -> DataFrame:
    """An answer for each order, its items as releases, newest first; counts, moments and owners of other types among them."""
    key = F.col("l_orderkey")
    stamp = F.concat(F.lit("2024-01-"), F.lpad((F.col("l_linenumber") * 3).cast("string"), 2, "0"), F.when(key % 5 == 0, "").when(key % 2 == 1, "T01:30:00.25+02:00").otherwise("T01:30:00Z"))
    retired = F.when(F.col("l_returnflag") == "R", '{"reason":"x"}').otherwise("null")
    release = F.format_string('{"version":"1.%d.0","inserted_at":"%s","retirement":%s}', "l_linenumber", stamp, retired)
    made = table(spark, sf_dir, "lineitem").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", release.alias("release"))), asc=False).alias("made"))
    releases = F.array_join(F.transform("made", lambda x: x["release"]), ",")
    downloads = F.when(key % 7 == 0, F.format_string('"%d"', key)).otherwise(F.format_string("%d", key * 10))
    owners = F.when(key % 3 == 0, "null").when(key % 3 == 1, '[{"u":"a"},{"u":"b"}]').otherwise("[]")
    text = F.format_string('{"meta":{"description":"d%d"},"downloads":{"all":%s,"week":1},"owners":%s,"releases":[%s]}', key, downloads, owners, releases)
    text = F.when(key % 43 == 5, F.left(text, F.lit(25))).when(key % 43 == 6, "[]").when(key % 43 == 9, '{"releases":"none"}').otherwise(text)
    return made.select("l_orderkey", text.alias("content"), F.when(key % 2 == 0, "1.3.0").alias("current"))


def registry_answers(spark, sf_dir):
    found = registry.registry(_answers(spark, sf_dir))
    return found.withColumn("released_at", F.date_format("released_at", "yyyy-MM-dd HH:mm:ss.SS")).withColumn("owners", F.col("owners").cast("long"))


def _stored(spark, sf_dir) -> DataFrame:
    """A stored history for each customer: an order a record, some with an unknown category or without a moment."""
    key = F.col("o_orderkey")
    category = F.when(key % 6 == 0, "telepathy").when(key % 6 == 1, "code_eval").otherwise("network_access")
    date = F.when(key % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    score = F.when(key % 4 == 0, "null").otherwise((key % 90).cast("string"))
    record = F.format_string('{"version":"0.%d.0","scan_date":"%s","finding_count":%d,"categories":["%s"],"risk_score":%s}', key % 9, date, key % 3, category, score)
    made = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", record.alias("record")))).alias("made"))
    text = F.concat(F.lit("["), F.array_join(F.transform("made", lambda x: x["record"]), ", "), F.lit("]"))
    text = F.when(F.col("o_custkey") % 31 == 3, F.left(text, F.lit(40))).when(F.col("o_custkey") % 31 == 4, "{}").otherwise(text)
    return made.select("o_custkey", text.alias("content"))


def stored_history(spark, sf_dir):
    found = registry.history(_stored(spark, sf_dir), F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return found.select(
        "o_custkey", F.col("place").cast("long").alias("place"), "version", F.date_format("scan_date", "yyyy-MM-dd HH:mm:ss").alias("scan_date"), "finding_count", F.array_join("categories", ",").alias("categories"), "risk_score"
    )


ANSWER_SQL = """
WITH x AS (SELECT l_orderkey AS k, list({'n': l_linenumber, 'p': l_partkey, 'r': l_returnflag} ORDER BY l_linenumber DESC, l_partkey DESC, l_returnflag DESC) AS made FROM lineitem GROUP BY 1),
t AS (SELECT k, k % 43 NOT IN (5, 6, 9) AS sound, k % 43 NOT IN (5, 6) AS doc, CASE WHEN k % 2 = 0 THEN '1.3.0' END AS current, made[1] AS newest, ['1.' || e.n || '.0' FOR e IN made] AS versions FROM x),
p AS (SELECT *, list_position(versions, coalesce(current, versions[1])) AS spot FROM t)
SELECT k AS l_orderkey, current, CASE WHEN sound THEN versions[1] END AS latest_version, CASE WHEN doc THEN CASE WHEN sound AND k % 7 <> 0 THEN k * 10 ELSE 0 END END AS downloads,
  CASE WHEN sound AND k % 5 <> 0 THEN CASE WHEN k % 2 = 1 THEN strftime(make_date(2024, 1, newest.n * 3) - INTERVAL 1 DAY, '%Y-%m-%d') || ' 23:30:00.25' ELSE strftime(make_date(2024, 1, newest.n * 3), '%Y-%m-%d') || ' 01:30:00.00' END END AS released_at,
  CASE WHEN sound THEN versions[spot + 1] END AS previous_version, CASE WHEN sound AND spot > 0 THEN coalesce(versions[spot + 10], versions[-1]) END AS lookback_version,
  CASE WHEN sound AND k % 3 = 1 THEN 2 WHEN sound AND k % 3 = 2 THEN 0 END AS owners, CASE WHEN sound THEN 'd' || k END AS description,
  CASE WHEN doc THEN sound AND newest.r = 'R' END AS retired, CASE WHEN NOT doc THEN 'no JSON object' END AS reason FROM p"""

HISTORY_SQL = """
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, '0.' || (o_orderkey % 9) || '.0' AS version,
  CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 5 = 0 THEN '2030-01-01 00:00:00' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS scan_date, o_orderkey % 3 AS finding_count,
  CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'code_eval' ELSE 'network_access' END AS categories, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 90 END AS risk_score
FROM orders WHERE o_custkey % 31 NOT IN (3, 4)"""

QUERIES = {"registry_answers": registry_answers, "stored_history": stored_history}
ORACLES = {"registry_answers": ANSWER_SQL, "stored_history": HISTORY_SQL}
