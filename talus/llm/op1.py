"""Query op1: personal data in all documents, base matches and what contexts add."""

from pyspark.sql import functions as F

from talus.llm.pii import find_pii, span_text
from talus.session import table


def op1_bootstrapped_pii(spark, sf_dir):
    base = ("email", "ip", "card", "phone")
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"),
    )


QUERIES = {"op1_bootstrapped_pii": op1_bootstrapped_pii}
ORACLES: dict[str, str] = {}
