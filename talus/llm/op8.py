"""Query op8: all documents encoded to pieces and decoded again."""

from pyspark.sql import functions as F

from talus.llm.pieces import encoded
from talus.session import table


def op8_sentencepiece(spark, sf_dir):
    rows = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "row.doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("piece_ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("row.text", F.lit("")).cast("binary")).alias("round_trip"),
    )


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLES: dict[str, str] = {}
