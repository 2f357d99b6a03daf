"""Query op3: toxicity of all documents, learned from the labels outside the held-out fold."""

from pyspark.sql import functions as F

from talus.llm.toxicity import fitted, fold, scored
from talus.session import table

REJECT = 0.3


def op3_subsequence_svm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = scored(docs, fitted(docs, labels)).select("row.doc_id", "score")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


QUERIES = {"op3_subsequence_svm": op3_subsequence_svm}
ORACLES: dict[str, str] = {}
