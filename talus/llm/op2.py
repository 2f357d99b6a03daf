"""Query op2: the language of all documents, learned outside the held-out fold."""

from pyspark.sql import functions as F

from talus.llm.language import held_out, identified, learned
from talus.session import table


def op2_kneser_ney(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = learned(docs.where(~held_out(F.col("doc_id"))))
    rows = identified(docs, models)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op2_kneser_ney": op2_kneser_ney}
ORACLES: dict[str, str] = {}
