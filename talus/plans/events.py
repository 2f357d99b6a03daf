"""Queries over the findings of the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions.scoring import popularity, risk_level
from talus.operators import correlate, history
from talus.operators.scoring import findings, package_scores
from talus.plans.risk import FINDINGS_SQL
from talus.session import table

WITH = f"WITH {FINDINGS_SQL}"


def _scores(spark, sf_dir):
    return package_scores(findings(spark, sf_dir))


def scan_summary(spark, sf_dir):
    return correlate.summary(_scores(spark, sf_dir))


def level_counts(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("risk_level").agg(F.count("*").alias("n"))


def threshold_gate(spark, sf_dir):
    return correlate.gate(_scores(spark, sf_dir))


def evidence_weighted_scores(spark, sf_dir):
    return correlate.evidence_rollup(findings(spark, sf_dir))


def _allowed(found):
    return found.where("user_id % 7 = 0 and category = 'view'")


def allowlist_antijoin(spark, sf_dir):
    found = findings(spark, sf_dir)
    return correlate.suppressed(found, _allowed(found)).select("event_id", "dep", "category")


def suppressed_semi(spark, sf_dir):
    found = findings(spark, sf_dir)
    return correlate.suppressed(found, _allowed(found), keep=True).select("event_id", "dep", "category")


def correlate_network_apply(spark, sf_dir):
    return correlate.escalated(findings(spark, sf_dir), "error", "purchase").select("event_id", "severity", F.col("evidence").cast("long").alias("evidence"))


def correlate_pair(spark, sf_dir):
    return correlate.paired(findings(spark, sf_dir), "signup", "error").select("event_id", "severity", F.col("evidence").cast("long").alias("evidence"))


def downgrade_paths(spark, sf_dir):
    return correlate.downgraded(findings(spark, sf_dir), "-0[0-5]$").select("event_id", "severity")


def scan_pipeline(spark, sf_dir):
    """Correlation, downgrade, allowlist, then scores: the fixed order of a scan."""
    found = findings(spark, sf_dir)
    allowed = _allowed(found)
    found = correlate.paired(correlate.escalated(found, "error", "purchase"), "signup", "error")
    found = correlate.suppressed(correlate.downgraded(found, "-0[0-5]$"), allowed)
    return package_scores(found)


def consensus(spark, sf_dir):
    votes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("package"), F.when(F.col("event_id") % 4 != 0, F.get_json_object("props", "$.k")).alias("findings_hash")
    )
    out = correlate.consensus(votes)
    return out.select("package", "findings_hash", F.round("agreement", 6).alias("agreement"), "total")


def _scans(spark, sf_dir):
    found = findings(spark, sf_dir)
    serious = F.col("severity") == "critical"
    return found.groupBy(F.col("user_id").alias("package"), F.date_format("ts", "yyyy-MM-dd").alias("version")).agg(
        F.max("ts").alias("scan_date"),
        F.count_if(serious).alias("finding_count"),
        F.collect_set(F.when(serious, F.col("category"))).alias("categories"),
    )


def clean_streak(spark, sf_dir):
    return history.streaks(_scans(spark, sf_dir), digits=6)


def anomaly_score(spark, sf_dir):
    return history.anomalies(_scans(spark, sf_dir))


def history_upsert_latest(spark, sf_dir):
    found = findings(spark, sf_dir)
    return history.latest(found, ["user_id", "category"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "category", "event_id", "severity")


def risk_timeline(spark, sf_dir):
    parts = F.split("dep", "/")
    scores = _scores(spark, sf_dir).select(parts[0].cast("long").alias("package"), parts[1].alias("scan_date"), "risk_score")
    return history.timeline(scores)


def aggregate_fold(spark, sf_dir):
    """Each package's state after all its events: the last scan and how much was appended to it."""
    e = findings(spark, sf_dir)
    scan = F.when(F.col("category") == "view", F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(
        F.max(scan)["event_id"].alias("last_scan"),
        F.count_if(F.col("category") == "signup").alias("attestations"),
        F.count_if(F.col("category") == "click").alias("suppressions"),
    )


def popularity_adjust(spark, sf_dir):
    downloads = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg((F.sum("l_quantity") * 1000).cast("long").alias("downloads"))
    raw = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), (F.col("s_suppkey") % 97 + 3).alias("raw"))
    joined = raw.join(downloads, "suppkey", "left")
    score = popularity(F.col("raw"), F.col("downloads"))
    return joined.select("suppkey", "downloads", score.alias("score"), risk_level(score).alias("risk_level"))


def window_risk(spark, sf_dir):
    """Tumbling risk per hour and type: the batch twin of the streaming rollup."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


def session_activity(spark, sf_dir):
    """Sessions of a user that end after 12 hours without an event."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


def sarif_results(spark, sf_dir):
    found = findings(spark, sf_dir)
    level = F.when(F.col("severity") == "critical", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    line = F.greatest(F.lit(1), F.hour("ts")).cast("long")
    return found.select("event_id", F.concat(F.lit("talus/"), "category").alias("rule_id"), level.alias("level"), line.alias("start_line"))


def sarif_rules(spark, sf_dir):
    found = findings(spark, sf_dir)
    return found.groupBy("category").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


def diagnostics_lines(spark, sf_dir):
    found = findings(spark, sf_dir)
    level = F.when(F.col("severity") == "critical", "error").when(F.col("severity") == "warning", "warning").otherwise("info")
    text = F.format_string("%s:%d: %s: [talus:%s] finding %d", "file_path", F.hour("ts"), level, "category", "event_id")
    return found.select("event_id", text.alias("line"))


def json_report(spark, sf_dir):
    return _scores(spark, sf_dir).select("dep", F.to_json(F.struct("dep", "risk_score", "risk_level")).alias("report"))


SCANS_SQL = """
scans AS (
  SELECT user_id AS package, strftime(ts, '%Y-%m-%d') AS version, max(ts) AS scan_date,
         count(*) FILTER (severity = 'critical') AS finding_count,
         list(DISTINCT category) FILTER (severity = 'critical') AS categories
  FROM findings GROUP BY 1, 2)"""
ALLOWED_SQL = "allowed AS (SELECT DISTINCT dep, category FROM findings WHERE user_id % 7 = 0 AND category = 'view')"
ESCALATED_SQL = """
escalated AS (
  SELECT * REPLACE (CASE WHEN category = 'error' AND bool_or(category = 'purchase') OVER (PARTITION BY dep) THEN 'critical' ELSE severity END AS severity,
                    CASE WHEN category = 'error' AND bool_or(category = 'purchase') OVER (PARTITION BY dep) THEN greatest(1, evidence) ELSE evidence END AS evidence)
  FROM findings)"""


def _paired_sql(source: str) -> str:
    hit = "category IN ('signup', 'error') AND bool_or(category = 'signup') OVER (PARTITION BY dep) AND bool_or(category = 'error') OVER (PARTITION BY dep)"
    return f"""
paired AS (
  SELECT * REPLACE (CASE WHEN {hit} THEN 'critical' ELSE severity END AS severity,
                    CASE WHEN {hit} THEN greatest(1, evidence) ELSE evidence END AS evidence)
  FROM {source})"""


DOWN = "CASE WHEN regexp_matches(file_path, '-0[0-5]$') AND NOT compile_time AND severity = 'warning' THEN 'info' ELSE severity END"
BASE_SQL = FINDINGS_SQL.split("based AS")[0].rstrip().rstrip(",")
AFTER_SQL = "based AS" + FINDINGS_SQL.split("based AS")[1]

QUERIES = {
    f.__name__: f
    for f in (
        scan_summary, level_counts, threshold_gate, evidence_weighted_scores, allowlist_antijoin, suppressed_semi,
        correlate_network_apply, correlate_pair, downgrade_paths, scan_pipeline, consensus, clean_streak, anomaly_score,
        history_upsert_latest, risk_timeline, aggregate_fold, popularity_adjust, window_risk, session_activity,
        sarif_results, sarif_rules, diagnostics_lines, json_report,
    )
}
ORACLES = {
    "scan_summary": f"""{WITH} SELECT count(*) AS n_deps, CAST(sum(finding_count) AS BIGINT) AS n_findings,
        count(*) FILTER (risk_level = 'low') AS n_low, count(*) FILTER (risk_level = 'medium') AS n_medium,
        count(*) FILTER (risk_level = 'high') AS n_high, count(*) FILTER (risk_level = 'critical') AS n_critical,
        max(risk_score) AS max_score, (SELECT dep FROM levels ORDER BY risk_score DESC, dep LIMIT 1) AS max_dep FROM levels""",
    "level_counts": f"{WITH} SELECT risk_level, count(*) AS n FROM levels GROUP BY risk_level",
    "threshold_gate": f"{WITH} SELECT coalesce(max(risk_score), 0) AS max_score, coalesce(max(risk_score), 0) >= 50 AS failed FROM levels",
    "evidence_weighted_scores": f"{WITH} SELECT evidence, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM scored GROUP BY evidence",
    "allowlist_antijoin": f"{WITH}, {ALLOWED_SQL} SELECT event_id, dep, category FROM findings f WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.dep = f.dep AND a.category = f.category)",
    "suppressed_semi": f"{WITH}, {ALLOWED_SQL} SELECT event_id, dep, category FROM findings f WHERE EXISTS (SELECT 1 FROM allowed a WHERE a.dep = f.dep AND a.category = f.category)",
    "correlate_network_apply": f"{WITH}, {ESCALATED_SQL} SELECT event_id, severity, CAST(evidence AS BIGINT) AS evidence FROM escalated",
    "correlate_pair": f"{WITH}, {_paired_sql('findings')} SELECT event_id, severity, CAST(evidence AS BIGINT) AS evidence FROM paired",
    "downgrade_paths": f"{WITH} SELECT event_id, {DOWN} AS severity FROM findings",
    "scan_pipeline": f"""WITH {BASE_SQL.replace('findings AS', 'raw_findings AS', 1)},
        {ALLOWED_SQL.replace('FROM findings', 'FROM raw_findings')}, {ESCALATED_SQL.replace('FROM findings', 'FROM raw_findings')}, {_paired_sql('escalated')},
        findings AS (SELECT * REPLACE ({DOWN} AS severity) FROM paired p WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.dep = p.dep AND a.category = p.category)),
        {AFTER_SQL} SELECT dep, finding_count, risk_score, risk_level FROM levels""",
    "consensus": """WITH counts AS (
        SELECT user_id AS package, CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k') END AS findings_hash, count(*) AS n
        FROM events GROUP BY 1, 2)
        SELECT package, findings_hash, round(CAST(n AS DOUBLE) / total, 6) AS agreement, total FROM (
          SELECT *, CAST(sum(n) OVER (PARTITION BY package) AS BIGINT) AS total,
                 row_number() OVER (PARTITION BY package ORDER BY n DESC, findings_hash NULLS LAST) AS turn FROM counts) WHERE turn = 1""",
    "clean_streak": f"""{WITH}, {SCANS_SQL},
        runs AS (SELECT *, sum(CASE WHEN finding_count > 0 THEN 1 ELSE 0 END) OVER (
                   PARTITION BY package ORDER BY scan_date DESC, version DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dirty FROM scans),
        sums AS (SELECT package, count(*) AS total, count(*) FILTER (dirty = 0) AS clean_streak FROM runs GROUP BY package)
        SELECT package, total, clean_streak, round(0.6::DOUBLE * clean_streak / total + 0.4::DOUBLE * least(1.0::DOUBLE, CAST(total AS DOUBLE) / 20), 6) AS trust FROM sums""",
    "anomaly_score": f"""{WITH}, {SCANS_SQL},
        placed AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY scan_date, version) AS place FROM scans),
        firsts AS (SELECT package, category, min(place) AS place FROM (SELECT package, place, unnest(categories) AS category FROM placed) GROUP BY 1, 2),
        fresh AS (SELECT package, place, count(*) AS fresh FROM firsts GROUP BY 1, 2),
        scored_scans AS (SELECT p.package, version,
          CAST(least(100, CASE WHEN finding_count >= 10 THEN 30 WHEN finding_count >= 5 THEN 20 WHEN finding_count >= 1 THEN 10 ELSE 0 END
                     + 15 * coalesce(f.fresh, 0)) AS BIGINT) AS anomaly
          FROM placed p LEFT JOIN fresh f ON p.package = f.package AND p.place = f.place WHERE p.place > 1)
        SELECT package, version, anomaly,
               CASE WHEN anomaly >= 30 THEN 'critical' WHEN anomaly >= 15 THEN 'warning' WHEN anomaly > 0 THEN 'info' ELSE 'none' END AS severity FROM scored_scans""",
    "history_upsert_latest": f"""{WITH} SELECT user_id, category, event_id, severity FROM findings
        QUALIFY row_number() OVER (PARTITION BY user_id, category ORDER BY ts DESC, event_id DESC) = 1""",
    "risk_timeline": f"""{WITH}, parts AS (SELECT CAST(split_part(dep, '/', 1) AS BIGINT) AS package, split_part(dep, '/', 2) AS scan_date, risk_score FROM levels)
        SELECT *, risk_score - lag(risk_score) OVER (PARTITION BY package ORDER BY scan_date) AS delta FROM parts""",
    "aggregate_fold": f"""{WITH} SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (category = 'view') AS last_scan,
        count(*) FILTER (category = 'signup') AS attestations, count(*) FILTER (category = 'click') AS suppressions FROM findings GROUP BY user_id""",
    "popularity_adjust": """WITH d AS (SELECT l_suppkey AS suppkey, CAST(sum(l_quantity) * 1000 AS BIGINT) AS downloads FROM lineitem GROUP BY 1),
        j AS (SELECT s_suppkey AS suppkey, s_suppkey % 97 + 3 AS raw, downloads FROM supplier LEFT JOIN d ON s_suppkey = suppkey),
        s AS (SELECT suppkey, downloads, CAST(floor(CASE WHEN downloads > 10000000 THEN raw * 0.3::DOUBLE WHEN downloads > 1000000 THEN raw * 0.5::DOUBLE
              ELSE raw * 1.0::DOUBLE END + 0.5::DOUBLE) AS BIGINT) AS score FROM j)
        SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS risk_level FROM s""",
    "window_risk": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total
        FROM events GROUP BY 1, 2""",
    "session_activity": """WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
        runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM gaps)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM runs GROUP BY user_id, run""",
    "sarif_results": f"""{WITH} SELECT event_id, 'talus/' || category AS rule_id,
        CASE severity WHEN 'critical' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level,
        greatest(1, extract(hour FROM ts)) AS start_line FROM findings""",
    "sarif_rules": f"{WITH} SELECT category, min(event_id) AS first_event, count(*) AS n FROM findings GROUP BY category",
    "diagnostics_lines": f"""{WITH} SELECT event_id, file_path || ':' || extract(hour FROM ts) || ': ' ||
        CASE severity WHEN 'critical' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'info' END || ': [talus:' || category || '] finding ' || event_id AS line FROM findings""",
    "json_report": f"""{WITH} SELECT dep, '{{"dep":"' || dep || '","risk_score":' || risk_score || ',"risk_level":"' || risk_level || '"}}' AS report FROM levels""",
}
