"""The publish service as a running stream: events read in bounded batches, scanned, and routed to their sinks.

A batch writes one folder of its number in every sink, so a batch that is tried again after a crash replaces what it
had written, and nothing is there twice. The latest state of a key is what its newest event says.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from talus.functions.scoring import risk_level

EVENT = "package string, version string, seq long, shift string"
REVIEW_FROM, NOTIFY_FROM = 30, 80
SINKS = ("package_scans", "risk_timeline", "reviews", "notifications", "dead_letters")


def published(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """The stream of text lines below ``path``, at most so many files in a batch."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def events(raw: DataFrame) -> DataFrame:
    """``raw`` (value) with the event's fields, and the reason why a line is none: no JSON object, or no package or version."""
    held = raw.select("value", F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"), F.try_parse_json("value").isNull().alias("broken"))
    reason = F.when(F.col("broken"), "no JSON").when(F.coalesce("e.package", F.lit("")) == "", "no package").when(F.coalesce("e.version", F.lit("")) == "", "no version")
    return held.select("value", "e.*", reason.alias("reason"))


def handled(found: DataFrame, scores: DataFrame) -> DataFrame:
    """Valid events with what a scan says of their package (``scores``: dep, finding_count, risk_score); without findings all is 0."""
    scanned = found.where("reason is null").join(scores.select(F.col("dep").alias("package"), "finding_count", "risk_score"), "package", "left")
    score = F.coalesce("risk_score", F.lit(0)).cast("long")
    return scanned.select("package", "version", "seq", "shift", F.coalesce("finding_count", F.lit(0)).cast("long").alias("finding_count"), score.alias("risk_score"), risk_level(score).alias("risk_level"))


def routes(found: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """What each sink gets of a batch: scans and their timeline, scans worth a review, scans or shifts worth a note, bad lines."""
    scans = handled(found, scores)
    columns = ["package", "version", "seq", "finding_count", "risk_score", "risk_level"]
    noted = (F.col("risk_score") >= NOTIFY_FROM) | F.coalesce(F.col("shift").isin("high", "critical"), F.lit(False))
    return {
        "package_scans": scans.select(*columns),
        "risk_timeline": scans.select("package", "version", "seq", "risk_score"),
        "reviews": scans.where((F.col("finding_count") > 0) & (F.col("risk_score") >= REVIEW_FROM)).select(*columns),
        "notifications": scans.where(noted).select("package", "version", "seq", "risk_score", "shift"),
        "dead_letters": found.where("reason is not null").select("value", "reason"),
    }


def projector(scores: DataFrame, out: str, wrote: Callable[[str, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over ``events``; ``wrote`` is told of each sink of a batch that stands."""

    def project(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for name, rows in routes(held, scores).items():
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
                if wrote:
                    wrote(name, batch_id)
        finally:
            held.unpersist()

    return project


def start(spark: SparkSession, source: str, scores: DataFrame, out: str, checkpoint: str, files_per_batch: int = 10, every: str | None = None, wrote=None) -> StreamingQuery:
    """Run the service over ``source``: on a trigger ``every`` so often, or once over all that is there."""
    found = events(published(spark, source, files_per_batch))
    # the numbers that dashboards read, from the stream itself
    found = found.observe("publish_events", F.count("*").alias("lines"), F.count_if(F.col("reason").isNotNull()).alias("bad"))
    writer = found.writeStream.option("checkpointLocation", checkpoint).foreachBatch(projector(scores, out, wrote))
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def sink(spark: SparkSession, out: str, name: str) -> DataFrame:
    """All rows of a sink with their batch."""
    return spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}")


def latest(scans: DataFrame) -> DataFrame:
    """The newest scan of each package and version: by the event's number, then by batch."""
    kept = [c for c in scans.columns if c not in ("package", "version", "batch")]
    newest = F.max_by(F.struct(*kept), F.struct("seq", "batch", "risk_score", "finding_count")).alias("s")
    return scans.groupBy("package", "version").agg(newest).select("package", "version", "s.*")


def scan_of(spark: SparkSession, out: str, package: str, version: str) -> DataFrame:
    """The newest scan of one package version: a filter on the key, before anything is grouped."""
    return latest(sink(spark, out, "package_scans").where((F.col("package") == package) & (F.col("version") == version)))


@dataclass
class Metrics(StreamingQueryListener):
    """Sums of what the stream observed, by batches that ended."""

    totals: dict[str, int] = field(default_factory=dict)
    batches: int = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get("publish_events")
        if row is not None and event.progress.numInputRows:
            self.batches += 1
            for name, n in row.asDict().items():
                self.totals[name] = self.totals.get(name, 0) + n

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
