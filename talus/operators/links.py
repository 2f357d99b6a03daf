"""Suspicious links in source lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pattern and what a match is.
LINKS = (
    (r"https?://[^\s\"']*\.xyz/", "top-level domain .xyz"),
    (r"https?://[^\s\"']*\.tk/", "top-level domain .tk"),
    (r"https?://[^\s\"']*\.ml/", "top-level domain .ml"),
    (r"https?://[^\s\"']*\.ga/", "top-level domain .ga"),
    (r"https?://[^\s\"']*\.cf/", "top-level domain .cf"),
    (r"ngrok\.io", "tunnel ngrok.io"),
    (r"serveo\.net", "tunnel serveo.net"),
    (r"localhost\.run", "tunnel localhost.run"),
    (r"pastebin\.com", "paste site"),
    (r"api\.telegram\.org", "messenger interface"),
    (r"discord\.com/api/webhooks", "chat webhook"),
    (r"(?i)requestbin", "request bin"),
    (r"https?://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "raw address"),
)


def shady_links(lines: DataFrame, path: str | None = None) -> DataFrame:
    """``lines`` (with a column line) exploded to one row a matching pattern, as ``reason``.

    Comment lines and lines that define patterns don't count, nor do files in test folders where the
    column ``path`` is named. One pass over the lines, no shuffle.
    """
    line = F.col("line")
    held = lines.where(~F.startswith(F.ltrim("line"), F.lit("#")) & ~F.contains(line, F.lit("~r/")) & ~F.contains(line, F.lit("~R/")))
    if path:
        held = held.where(~F.col(path).rlike("(^|/)test/"))
    hits = F.array_compact(F.array(*[F.when(line.rlike(p), F.lit(reason)) for p, reason in LINKS]))
    return held.withColumn("reason", F.explode(hits))
