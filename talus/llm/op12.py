"""Query op12: all documents by two tokenizers, aligned."""

from pyspark.sql import functions as F

from talus.llm.alignment import aligned
from talus.session import table


def op12_token_alignment(spark, sf_dir):
    rows = aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True, keep=["doc_id"])
    return rows.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        *[F.col(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
        F.col("groups").alias("groups_sha256"),
    )


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
