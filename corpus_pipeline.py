"""The corpus pipeline: toxic documents out, repeated lines out, near copies out, sources mixed, encoded.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept. All but
the last return the columns of documents, with n_chars following the text.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import pieces
from talus.llm.line_dedup import dedup_lines, small
from talus.llm.mixing import mixed
from talus.llm.near_dedup import near_groups
from talus.llm.op3 import REJECT
from talus.llm.toxicity import fitted, scored
from talus.session import drop_written, table, tables_written, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the limit; the model learns from labels outside its held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = scored(docs, fitted(docs.select("doc_id", "text"), labels))
    return rows.where(F.col("score") < REJECT).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one, exactly at any length; a document left without any text goes."""
    kept = dedup_lines(docs, exact=1).where((F.col("n_removed") == 0) | (F.trim("row.text") != ""))
    shorter = F.col("row").withField("n_chars", F.char_length("row.text").cast("long"))
    return kept.select(F.when(F.col("n_removed") > 0, shorter).otherwise(F.col("row")).alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies; rows that repeat a doc_id go only together."""
    groups = near_groups(docs.select("doc_id", "text"), size=5, percent=80)
    gone = groups.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept")
    return docs.join(small(written(gone.select("doc_id"), "gone"), F.lit(24)), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the sources' target weights take, in training order."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece_ids and position, the place in training order; columns of these names give way."""
    kept = [c for c in docs.columns if c.lower() not in ("piece_ids", "position")]
    rows = pieces.encoded(docs.select(*[F.col(f"`{c}`") for c in kept], stored_place(docs).alias("position")))
    return rows.select("row.*", "piece_ids")


def stored_place(docs: DataFrame) -> Column:
    """A row's place in the order that a table was written in: its file's number, then its row; null elsewhere."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.lit(None).cast("long")
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    return F.shiftleft(file, 40) + F.col("_metadata.row_index")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), tables_written()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_written(spark, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
