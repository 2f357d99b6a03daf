"""Query op10: all documents mixed to the weights 1, 2, 3 of their sources."""

from talus.llm.mixing import by_position, mix_plan
from talus.session import table


def op10_curriculum_mix(spark, sf_dir):
    return by_position(mix_plan(table(spark, sf_dir, "documents")).drop("start", "tilt", "text_key", "key"))


SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM totals),
levelled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW below AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, weight,
         coalesce(first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS) OVER (
           ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * weight,
           CAST(cap AS DOUBLE)) AS target
  FROM levelled),
placed AS (
  SELECT doc_id, size, source_size, target, weight, CAST(floor(target) AS BIGINT) AS goal,
         CAST(coalesce(sum(size) OVER (PARTITION BY base.source
           ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM base JOIN targets ON base.source IS NOT DISTINCT FROM targets.source),
taking AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM placed),
took AS (
  SELECT *, passes * size + least(size, greatest(0, goal - passes * source_size - start)) AS taken,
         start / target AS share, (weight - 2) * 0.5::DOUBLE AS tilt
  FROM taking)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken, CAST(weight AS BIGINT) AS weight,
       CASE WHEN taken > 0 THEN CASE WHEN tilt = 0 THEN share
            ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share) - (1 - tilt)) / (2 * tilt) + 0.0::DOUBLE END END AS position
FROM took
"""

QUERIES = {"op10_curriculum_mix": op10_curriculum_mix}
ORACLES = {"op10_curriculum_mix": SQL}
