"""Query op11: quality of all documents, learned from the labels outside the held-out fold."""

from pyspark.sql import functions as F

from talus.llm.quality import fitted, scored
from talus.llm.toxicity import fold
from talus.session import table

ACCEPT = 0.3


def op11_byte_convolution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = scored(docs, fitted(docs, labels)).select("row.doc_id", "score")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


QUERIES = {"op11_byte_convolution": op11_byte_convolution}
ORACLES: dict[str, str] = {}
