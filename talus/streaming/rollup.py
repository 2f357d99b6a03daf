"""Streaming twins: publish events to projections, windowed risk, and the aggregate's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUBLISHED = "package string, version string, score long"


def parsed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid publish events, dead letters with a reason) of a frame with a JSON string ``value``."""
    held = raw.withColumn("e", F.from_json("value", PUBLISHED))
    wrong = F.col("e").isNull() | F.col("e.package").isNull() | F.col("e.version").isNull()
    return held.where(~wrong).select("e.*"), held.where(wrong).select("value", F.lit("invalid payload").alias("reason"))


def windowed_risk(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and totals of (ts, event_type, value), for batch or stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def folded(commands: DataFrame) -> DataFrame:
    """package_name, scans, attestations, suppressions, rejected: the state that each package's
    commands leave. A second suppression of one finding is rejected. Keyed by package alone."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        scans, attestations, rejected, seen = state.get if state.exists else (0, 0, 0, [])
        seen = set(seen)
        for batch in batches:
            for kind, finding in zip(batch["kind"], batch["finding"]):
                if kind == "scan":
                    scans += 1
                elif kind == "attest":
                    attestations += 1
                elif kind == "suppress" and finding in seen:
                    rejected += 1
                elif kind == "suppress":
                    seen.add(finding)
        state.update((scans, attestations, rejected, sorted(seen)))
        yield pd.DataFrame({"package_name": [key[0]], "scans": [scans], "attestations": [attestations], "suppressions": [len(seen)], "rejected": [rejected]})

    return commands.groupBy("package_name").applyInPandasWithState(
        step,
        "package_name string, scans long, attestations long, suppressions long, rejected long",
        "scans long, attestations long, rejected long, seen array<string>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def projection(path: str):
    """A ``foreachBatch`` function that writes each micro-batch to the scan and timeline projections.

    A batch goes to a folder of its own number, so one that is tried again replaces itself.
    """

    def project(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, rows in (("package_scans", batch.select("package", "version", "score")), ("risk_timeline", batch.select("package", "score", F.current_timestamp().alias("at")))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        batch.unpersist()

    return project
