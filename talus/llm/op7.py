"""Query op7: all documents without lines that repeat an earlier one up to an edit."""

from pyspark.sql import functions as F

from talus.llm.line_dedup import dedup_lines
from talus.session import table


def op7_deletion_neighbourhood(spark, sf_dir):
    return _hashed(dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_deletion_neighbourhood_whole(spark, sf_dir):
    """As above, and exact repeats of shorter lines go too."""
    return _hashed(dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), exact=1))


def _hashed(docs):
    return docs.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH rows AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, CAST(i AS BIGINT) AS pos, parts[i] AS line, length(parts[i]) AS n
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM rows)),
wanted AS (SELECT * FROM lines WHERE n >= 20 AND trim(line, ' ') <> ''),
firsts AS (SELECT line, min({'d': doc_id, 'a': pos}) AS first FROM wanted GROUP BY line),
keyed AS (
  SELECT line, first, length(line) AS n, base, side,
         CASE side WHEN 'p' THEN left(line, base // 2) ELSE right(line, base - base // 2) END AS part
  FROM firsts, (VALUES (0), (1)) AS less(k), (VALUES ('p'), ('s')) AS sides(side), LATERAL (SELECT length(line) - k AS base)),
pairs AS (
  SELECT DISTINCT x.line, y.line AS earlier
  FROM keyed x JOIN keyed y ON x.base = y.base AND x.side = y.side AND x.part = y.part AND y.first < x.first AND x.line <> y.line
  WHERE abs(x.n - y.n) <= 1),
near AS (
  SELECT DISTINCT line FROM pairs
  WHERE list_bool_or([left(line, i) = left(earlier, i)
                      AND (right(line, length(line) - i - 1) = right(earlier, length(earlier) - i - 1)
                           OR right(line, length(line) - i) = right(earlier, length(earlier) - i - 1)
                           OR right(line, length(line) - i - 1) = right(earlier, length(earlier) - i))
                      FOR i IN range(0, least(length(line), length(earlier)) + 1)])),
judged AS (
  SELECT lines.doc_id, lines.pos, lines.line,
         w.first IS NOT NULL AND (near.line IS NOT NULL OR {'d': lines.doc_id, 'a': lines.pos} > w.first) AS gone
  FROM lines LEFT JOIN firsts w ON lines.line = w.line LEFT JOIN near ON lines.line = near.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

#: Every line that isn't blank can repeat an earlier one; only long ones are compared up to an edit.
WHOLE_SQL = SQL.replace(
    "WHERE n >= 20 AND trim(line, ' ') <> ''", r"WHERE CASE WHEN n >= 20 THEN trim(line, ' ') <> '' ELSE regexp_matches(line, '\S') END"
).replace("AS sides(side), LATERAL (SELECT length(line) - k AS base)", "AS sides(side), LATERAL (SELECT length(line) - k AS base) WHERE length(line) >= 20")

QUERIES = {f.__name__: f for f in (op7_deletion_neighbourhood, op7_deletion_neighbourhood_whole)}
ORACLES = {"op7_deletion_neighbourhood": SQL, "op7_deletion_neighbourhood_whole": WHOLE_SQL}
