"""Scoring queries over the findings of the event table."""

from __future__ import annotations

from talus.operators.scoring import findings, package_scores

FINDINGS_SQL = """
findings AS (
  SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS dep,
         CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d-%H') AS file_path,
         event_id, user_id, ts, event_type AS category,
         CASE WHEN value >= 40 THEN 'critical' WHEN value >= 15 THEN 'warning' ELSE 'info' END AS severity,
         event_id % 3 = 0 AS compile_time,
         coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) % 5 AS evidence
  FROM events),
based AS (
  SELECT *, CASE WHEN severity = 'critical' AND compile_time THEN 40 WHEN severity = 'critical' THEN 15
                 WHEN severity = 'warning' AND compile_time THEN 20 WHEN severity = 'warning' THEN 5 ELSE 1 END AS base
  FROM findings),
scored AS (
  SELECT *, CASE base WHEN 40 THEN [40, 52, 60, 68, 100] WHEN 20 THEN [20, 26, 30, 34, 50] WHEN 15 THEN [15, 20, 23, 26, 38]
                      WHEN 5 THEN [5, 7, 8, 9, 13] ELSE [1, 1, 2, 2, 3] END[evidence + 1] AS score
  FROM based),
buckets AS (
  SELECT dep, file_path, category, max(score) + count(*) - 1 AS bucket, count(*) AS n FROM scored GROUP BY ALL),
raws AS (SELECT dep, sum(bucket) AS raw, CAST(sum(n) AS BIGINT) AS finding_count FROM buckets GROUP BY dep),
deps AS (SELECT dep, finding_count, CAST(least(100, raw) AS BIGINT) AS risk_score FROM raws),
levels AS (
  SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 50 THEN 'high'
                 WHEN risk_score >= 20 THEN 'medium' ELSE 'low' END AS risk_level FROM deps)
"""


def score_deps(spark, sf_dir):
    return package_scores(findings(spark, sf_dir))


QUERIES = {"score_deps": score_deps}
ORACLES = {"score_deps": f"WITH {FINDINGS_SQL} SELECT dep, finding_count, risk_score, risk_level FROM levels"}
