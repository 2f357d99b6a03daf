from pyspark.sql import functions as F

from talus.functions.scoring import finding_score, popularity, risk_level, severity_base
from talus.operators.scoring import package_scores


def test_score_table_and_levels(spark):
    rows = spark.createDataFrame(
        [("critical", True, 4), ("critical", False, 1), ("warning", True, 2), ("warning", False, 3), ("info", True, 0), ("info", False, 9)],
        "severity string, compile_time boolean, evidence int",
    )
    got = rows.select(finding_score(severity_base(F.col("severity"), F.col("compile_time")), F.col("evidence")).alias("s")).collect()
    assert [r.s for r in got] == [100, 20, 30, 9, 1, 1]
    levels = spark.createDataFrame([(0,), (19,), (20,), (49,), (50,), (79,), (80,), (100,)], "s int").select(risk_level(F.col("s")).alias("l"))
    assert [r.l for r in levels.collect()] == ["low", "low", "medium", "medium", "high", "high", "critical", "critical"]


def test_popularity_is_strict(spark):
    rows = spark.createDataFrame([(50, 10_000_000), (50, 10_000_001), (50, 1_000_001), (50, None)], "s long, d long")
    assert [r.p for r in rows.select(popularity(F.col("s"), F.col("d")).alias("p")).collect()] == [25, 15, 25, 50]


def test_bucket_score_and_cap(spark):
    rows = spark.createDataFrame(
        [("d", "f", "c", "critical", True, 0), ("d", "f", "c", "info", False, 0), ("d", "g", "c", "warning", False, 0)]
        + [("e", str(i), "c", "critical", True, 0) for i in range(5)],
        "dep string, file_path string, category string, severity string, compile_time boolean, evidence int",
    )
    got = {r.dep: (r.finding_count, r.risk_score, r.risk_level) for r in package_scores(rows).collect()}
    assert got == {"d": (3, 46, "medium"), "e": (5, 100, "critical")}
